"""Request-log summaries and the load gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.operators import order_stats
from turnstone.session import ensure_checkpoint_dir
from turnstone.settings import DEFAULTS, Settings

TOTAL = "Aggregated"  # fixed value: the name of the all-requests row
LOG = "ts timestamp, type string, name string, ms double, failed boolean"


def request_summary(log: DataFrame) -> DataFrame:
    """Per endpoint and over all: requests, failures, req/s, p50, p95, p99.

    A first pass keeps counts and a sketch per endpoint, which merge into the total's;
    a second counts the latencies near the wanted ranks.
    """
    ensure_checkpoint_dir(log.sparkSession)
    keys = ["type", "name"]
    each = log.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if("failed").alias("failures"), F.min("ts").alias("t0"),
        F.max("ts").alias("t1"), F.count_if(order_stats.is_value("ms")).alias("total"), order_stats.sketch("ms").alias("sketch")).checkpoint()
    over_all = each.agg(
        *[F.sum(c).alias(c) for c in ("requests", "failures")], F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        F.sum("total").alias("total"), order_stats.merged("sketch").alias("sketch")).where("requests > 0").select(
        F.lit("").alias("type"), F.lit(TOTAL).alias("name"), "*")
    whole = each.agg((F.max("t1").cast("timestamp").cast("double")
                      - F.min("t0").cast("timestamp").cast("double")).alias("s")).scalar()
    sums = each.unionByName(over_all)
    both = log.select(F.explode(F.array(
        F.struct("type", "name"), F.struct(F.lit("").alias("type"), F.lit(TOTAL).alias("name")))).alias("k"), "ms").select("k.*", "ms")
    ranks = {f"p{p}": order_stats.index_rank(p / 100) for p in (50, 95, 99)}
    stats = order_stats.order_statistics(both, keys, "ms", ranks, sums.select(*keys, "total", "sketch"))
    return sums.drop("total", "sketch").join(stats.drop("total"), keys, "left").select(
        *keys, "requests", "failures",
        (F.col("requests") / F.nullif(whole, F.lit(0.0))).alias("per_second"),
        "p50", "p95", "p99")


def load_gate(summary: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row from the total: breaches, and whether the run passes. No requests
    at all is a failure."""
    total = summary.where(F.col("name") == TOTAL).agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"), F.max("p95").alias("p95"))
    ratio = F.col("failures") / F.nullif(F.col("requests"), F.lit(0))
    breaches = F.array_compact(F.array(
        F.when(F.col("requests") == 0, F.lit("no_requests")),
        F.when(ratio > settings.max_failure_ratio, F.lit("failure_ratio")),
        F.when(F.col("p95") > settings.max_p95_ms, F.lit("p95"))))
    return total.select("requests", "failures", ratio.alias("failure_ratio"), "p95",
                        breaches.alias("breaches")).withColumn("passed", F.size("breaches") == 0)
