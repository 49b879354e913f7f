"""Citation numbering of logged turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import citing
from turnstone.operators.running import numbered


def number_passages(turn_hits: DataFrame) -> DataFrame:
    """``turn_id, chunk_id, n``: a passage is numbered where it first appears and
    keeps the number when a later search of the turn returns it again.
    ``turn_hits(turn_id, search_no, rank, chunk_id)``."""
    first = turn_hits.groupBy("turn_id", "chunk_id").agg(
        F.min(F.struct("search_no", "rank")).alias("at"))
    flat = first.select("turn_id", "chunk_id", "at.search_no", "at.rank")
    return numbered(flat, ["turn_id"], [F.col("search_no"), F.col("rank"), F.col("chunk_id")],
                    F.col("search_no"), "n").select("turn_id", "chunk_id", "n")


def cited_passages(turn_hits: DataFrame, outputs: DataFrame,
                   own_evidence: DataFrame | None = None) -> DataFrame:
    """``turn_id, n, chunk_id`` for what the reply and documents of a turn cite.
    A turn with evidence of its own (``turn_id, n, chunk_id``) keeps exactly that."""
    used = outputs.select("turn_id", F.explode(citing.cited_numbers(F.col("text"))).alias("n"))
    found = number_passages(turn_hits).join(used.distinct(), ["turn_id", "n"], "left_semi")
    found = found.select("turn_id", "n", "chunk_id")
    if own_evidence is None:
        return found
    others = found.join(own_evidence.select("turn_id").distinct(), "turn_id", "left_anti")
    return others.unionByName(own_evidence.select("turn_id", "n", "chunk_id"))


def audit(events: DataFrame, turns: DataFrame, trivial: Column | None = None) -> DataFrame:
    """Which turn rules a logged turn broke.

    ``turns(turn_id, message, reply)``; ``events(turn_id, seq, kind, ok, grounded)``
    with kind ``search`` or ``document`` and ``ok`` false for calls that were
    blocked or failed. Every rule is an aggregate over a turn's events, so events
    are combined before they are shuffled.
    """
    is_search, is_doc = F.col("kind") == "search", F.col("kind") == "document"
    ok = F.col("ok")
    per_turn = events.groupBy("turn_id").agg(
        F.count("*").alias("calls"),
        F.min(F.when(is_search & ok, F.col("seq"))).alias("first_search"),
        F.max(F.when(is_search & ok, F.coalesce("grounded", F.lit(False)))).alias("grounded"),
        F.min(F.when(is_doc, F.col("seq"))).alias("first_document"),
        F.count_if(is_doc).alias("document_calls"),
        F.count_if(is_doc & ok).alias("documents"))
    trivial = citing.is_trivial(F.col("message")) if trivial is None else trivial
    t = turns.withColumn("_trivial", trivial).join(per_turn, "turn_id", "left").fillna(
        {"calls": 0, "document_calls": 0, "documents": 0})
    searched = F.col("first_search").isNotNull()
    grounded = F.coalesce("grounded", F.lit(False))
    wants = citing.asks_for_document(F.col("message"))
    return t.select(
        "turn_id",
        (~F.col("_trivial") & ~searched & (F.col("documents") == 0)).alias("answered_without_search"),
        (~F.col("_trivial") & F.coalesce(
            F.col("first_document") < F.coalesce(F.col("first_search"), F.lit(1 << 40)),
            F.lit(False))).alias("document_before_search"),
        (F.col("document_calls") > 1).alias("second_document"),
        (searched & ~grounded & ~citing.reads_as_refusal(F.col("reply"))).alias(
            "ungrounded_not_refused"),
        (wants & (F.col("documents") == 0) & (~searched | grounded)).alias("document_missing"),
        (F.col("_trivial") & (F.col("calls") > 0)).alias("tools_on_trivial"))
