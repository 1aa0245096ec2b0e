"""Query of the near-duplicate operator. XXH64 is not in the checking SQL's dialect, so there is none."""

from pyspark.sql import DataFrame, SparkSession

from veriframe.llm import simhash_dedup
from veriframe.sources.tables import read_table


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
