"""Retrieval and conversation evaluation with pass/fail gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import citing
from turnstone.operators import order_stats
from turnstone.settings import DEFAULTS, Settings

TOP_GUESTS = 5


def retrieval_rows(golden: DataFrame, verdicts: DataFrame, enriched: DataFrame) -> DataFrame:
    """One scored row per question. ``golden(query_id, category, expect_grounded,
    expect_guest)``."""
    guests = enriched.where(F.col("rank") <= TOP_GUESTS).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "guest"))).alias("g"))
    rows = golden.join(verdicts, "query_id").join(guests, "query_id", "left").withColumn(
        "top_guests", F.coalesce(F.col("g.guest"), F.array().cast("array<string>")))
    named = F.exists("top_guests", lambda g: F.lower(g) == F.lower("expect_guest"))
    return rows.select(
        "query_id", "category", "expect_grounded", F.col("grounded").alias("actual_grounded"),
        F.round("best_similarity", 4).alias("best_similarity"), "top_guests", "expect_guest",
        F.when(F.col("expect_guest").isNotNull(), F.col("grounded") & named).alias("guest_matched"),
        (F.col("grounded") == F.col("expect_grounded")).alias("correct"))


def _rate(flag: Column, where: Column) -> Column:
    return F.avg(F.when(where, F.coalesce(flag, F.lit(False)).cast("double")))


def retrieval_summary(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: rates (null where nothing applies), gap between the two groups'
    similarities, gate and its messages."""
    inside, outside = F.col("category") == "in_domain", F.col("category") == "out_of_domain"
    s = rows.agg(
        F.count("*").alias("n_questions"),
        _rate(F.col("actual_grounded"), inside).alias("grounded_answer_rate"),
        _rate(F.col("actual_grounded"), outside).alias("false_ground_rate"),
        _rate(F.col("guest_matched"), inside & F.col("expect_guest").isNotNull()).alias(
            "guest_match_precision"),
        (F.min(F.when(inside, F.col("best_similarity")))
         - F.max(F.when(outside, F.col("best_similarity")))).alias("similarity_gap"))
    low = F.col("grounded_answer_rate") < settings.min_grounded_rate
    false = F.col("false_ground_rate") > settings.max_false_ground_rate
    percent = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    failures = F.array_compact(F.array(
        F.when(low, F.concat(F.lit("grounded answer rate "), percent(F.col("grounded_answer_rate")),
                             F.lit(f" is below {settings.min_grounded_rate:.0%}"))),
        F.when(false, F.concat(F.lit("false-ground rate "), percent(F.col("false_ground_rate")),
                               F.lit(f" is above {settings.max_false_ground_rate:.0%}")))))
    return s.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def latency_summary(rows: DataFrame, keys=(), value: str = "latency_ms") -> DataFrame:
    """Median, ``sorted[int(0.95 n)]`` and maximum, exact. Null and NaN do not count."""
    keyed = rows.select(*keys, F.lit(0).alias("_all"), value)
    low, high = order_stats.median_ranks()
    stats = order_stats.order_statistics(
        keyed, [*keys, "_all"], value,
        {"_low": low, "_high": high, "p95": order_stats.index_rank(0.95), "max": F.col("total")})
    return stats.select(*keys, F.col("total").alias("n"),
                        ((F.col("_low") + F.col("_high")) / 2).alias("p50"), "p95", "max")


def score_turns(turn_log: DataFrame, expectations: DataFrame) -> DataFrame:
    """``checks`` by name and ``correct`` per logged turn. Only tool calls that ran
    count; nothing to check is correct. A provider error is a failed turn and later
    turns of that scenario are left out."""
    t = turn_log.join(expectations.select(
        "scenario", "turn_no", "any_of", "forbidden", "max_calls",
        F.col("grounded").alias("want_grounded"), F.col("artifact").alias("want_artifact"),
        "refusal", "forbidden_text"), ["scenario", "turn_no"])
    first_error = turn_log.where(F.col("error").isNotNull()).groupBy("scenario").agg(
        F.min("turn_no").alias("_stop"))
    t = t.join(first_error, "scenario", "left").where(
        F.col("_stop").isNull() | (F.col("turn_no") <= F.col("_stop")))
    ran = F.transform(F.filter("tool_calls", lambda c: F.coalesce(c["ok"], F.lit(True))),
                      lambda c: c["tool"])
    t = t.withColumn("_ran", F.coalesce(ran, F.array().cast("array<string>")))
    some = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0

    def entry(applies: Column, name: str, ok: Column) -> Column:
        return F.when(applies, F.struct(F.lit(name).alias("key"), ok.alias("value")))

    overlap = lambda c: F.exists(c, lambda x: F.array_contains("_ran", x))
    fixed = F.array_compact(F.array(
        entry(some("any_of"), "expected_tool_called", overlap("any_of")),
        entry(some("forbidden"), "no_forbidden_tools", ~overlap("forbidden")),
        entry(F.col("want_grounded").isNotNull(), "grounded_as_expected",
              F.col("grounded") == F.col("want_grounded")),
        entry(F.col("want_artifact").isNotNull(), "artifact_as_expected",
              (F.col("n_artifacts") > 0) == F.col("want_artifact")),
        entry(F.coalesce("refusal", F.lit(False)), "refusal_language_present",
              citing.reads_as_refusal(F.col("content"))),
        entry(some("forbidden_text"), "no_forbidden_reply_patterns",
              ~F.exists("forbidden_text", lambda p: F.contains(F.col("content"), p)))))
    limits = F.transform(
        F.map_entries(F.coalesce("max_calls", F.create_map().cast("map<string,int>"))),
        lambda e: F.struct(
            F.concat(F.lit("no_redundant_"), e["key"]).alias("key"),
            (F.size(F.filter("_ran", lambda x: x == e["key"])) <= e["value"]).alias("value")))
    failed_call = F.array(F.struct(F.lit("provider_call_succeeded").alias("key"),
                                   F.lit(False).alias("value")))
    checks = F.map_from_entries(F.when(F.col("error").isNotNull(), failed_call).otherwise(
        F.concat(fixed, limits)))
    return t.withColumn("checks", checks).select(
        "scenario", "category", "turn_no", "checks",
        F.forall(F.map_values("checks"), lambda ok: ok).alias("correct"))


def scenarios(turns: DataFrame) -> DataFrame:
    return turns.groupBy("scenario", "category").agg(
        F.bool_and("correct").alias("correct"), F.count("*").alias("n_turns"))


def category_rates(scored: DataFrame) -> DataFrame:
    return scored.groupBy("category").agg(
        F.avg(F.col("correct").cast("double")).alias("pass_rate"), F.count("*").alias("n"))


def scenario_failures(turns: DataFrame) -> DataFrame:
    bad = F.array_sort(F.map_keys(F.map_filter("checks", lambda _, ok: ~ok)))
    return turns.where(~F.col("correct")).select(
        "scenario", "turn_no", F.array_join(bad, ", ").alias("failed_checks"))


def scenario_gate(scored: DataFrame) -> DataFrame:
    """Passed when there is at least one scenario and all are correct."""
    return scored.agg(F.count("*").alias("n_scenarios"),
                      F.coalesce(F.bool_and("correct"), F.lit(False)).alias("passed"))

