"""Golden questions, scenarios and request logs as JSON lines; summaries as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstone.operators.load_report import LOG

GOLDEN = "query_id string, query string, category string, expect_grounded boolean, expect_guest string"
EXPECTATIONS = (
    "scenario string, category string, slow boolean, turn_no int, message string, any_of array<string>, "
    "forbidden array<string>, max_calls map<string,int>, grounded boolean, artifact boolean, "
    "refusal boolean, forbidden_text array<string>")
TURN_LOG = (
    "scenario string, category string, turn_no int, tool_calls array<struct<tool:string,ok:boolean>>, "
    "grounded boolean, n_artifacts int, content string, error string")


def golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path)


def expectations(spark: SparkSession, path: str, include_slow: bool = True) -> DataFrame:
    rows = spark.read.schema(EXPECTATIONS).json(path)
    return rows if include_slow else rows.where("not coalesce(slow, false)")


def turn_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TURN_LOG).json(path)


def request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row summary; whoever starts the job decides where it goes."""
    summary.write.mode("overwrite").json(path)
