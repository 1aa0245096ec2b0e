"""Queries of the operators on pages, vectors and token sequences, with checking SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession

from veriframe.llm import main_text, token_packing, vector_topk
from veriframe.sources.tables import read_table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read_table(spark, sf_dir, "pages"))


def op7_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id 100 divides."""
    vectors = vector_topk.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return vector_topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.pack(read_table(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), whole AS (
  SELECT vec_id, min([CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding]) AS v
  FROM usable GROUP BY vec_id
), terms AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM whole
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM terms q JOIN terms c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""
