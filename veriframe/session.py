"""Session helpers: checkpoint folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and streaming state.

    The cluster names it in ``spark.checkpoint.dir``. A local session (tests) without that setting
    gets a temporary folder of its own.
    """
    current = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if configured is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="veriframe-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for streaming checkpoints and written tables."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once as Parquet below the shared folder and read back: steps that share it don't run it twice, each reads
    its own columns, and Spark knows its size (for a join result it takes the product of the two sides)."""
    place = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
