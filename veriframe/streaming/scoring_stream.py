"""Incremental scoring: each micro-batch of observations is scored once, the rest at the end."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.operators import scoring
from veriframe.session import scratch_path

#: Folders that the ids of a batch are dealt to by hash.
BUCKETS = 32
SCORED_SCHEMA = "cand_id string, entity_id bigint, points bigint, tier string, reject_reason string"


def _keep(scored: DataFrame) -> DataFrame:
    return scored.select("cand_id", "entity_id", "points", "tier", "reject_reason")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("cand_id"), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, path: str) -> DataFrame:
    """The scored table: part (batch) and bucket (of the id) are folders. Empty before the first batch."""
    schema = SCORED_SCHEMA + ", part int, bucket int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def earlier_ids(spark: SparkSession, path: str, before: int, buckets: list[int]) -> DataFrame:
    """Ids scored by earlier batches in the given buckets; other folders are not read, nor is that of the running batch,
    so a replay scores it again."""
    return _table(spark, path).filter((F.col("part") < before) & F.col("bucket").isin(buckets)).select("cand_id")


def score_stream(observations: DataFrame, candidates: DataFrame, entities: DataFrame, spark: SparkSession,
                 as_of_year: int, path: str | None = None, checkpoint: str | None = None) -> str:
    """Score observations as they arrive; returns the path of the scored table (a folder per batch and id bucket).

    A batch looks for ids that are scored already in the buckets it touches only.
    """
    path = path or scratch_path(spark, "scored")

    def score(batch: DataFrame, batch_id: int) -> None:
        touched = [r["bucket"] for r in batch.select(_bucket().alias("bucket")).distinct().collect()]
        fresh = scoring.latest_observations(batch).join(earlier_ids(spark, path, batch_id, touched), "cand_id", "left_anti")
        scored = scoring.score_observed(candidates, entities, fresh, as_of_year)
        _keep(scored).withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/part={batch_id}")

    run = (observations.writeStream.foreachBatch(score)
           .option("checkpointLocation", checkpoint or scratch_path(spark, "scored-state")).trigger(availableNow=True).start())
    run.awaitTermination()
    return path


def finish(candidates: DataFrame, entities: DataFrame, spark: SparkSession, path: str, as_of_year: int) -> DataFrame:
    """Everything scored so far plus the candidates no observation came for; all of them if no batch ever ran."""
    done = _table(spark, path).drop("part", "bucket")
    rest = candidates.join(done.select("cand_id"), "cand_id", "left_anti")
    none = spark.createDataFrame([], "cand_id string, image_type string, stock_like boolean, primary_category string, "
                                     "secondary_categories array<string>, visible_text string, names_institution string, "
                                     "other_institution_name string, scene string, close_up_portrait boolean")
    return done.unionByName(_keep(scoring.score_photos(rest, entities, none, as_of_year)))
