"""Queries of the operators on document texts. Their rules (entropy, rankings, fitted weights) are not SQL's."""

from pyspark.sql import DataFrame, SparkSession

from veriframe.llm import language_id, quality_model, secret_scan
from veriframe.sources.tables import read_table


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.rate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
