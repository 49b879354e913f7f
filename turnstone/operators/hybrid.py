"""Hybrid search over a query table: two ranked arms, fused, judged, shaped."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import search as fx
from turnstone.functions import text as tx
from turnstone.operators import postings, vector
from turnstone.operators.bounds import broadcast_if_small
from turnstone.operators.graph import Graph
from turnstone.operators.graph import search as graph_search
from turnstone.operators.tables import fresh_path, stored
from turnstone.session import ensure_checkpoint_dir
from turnstone.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Search:
    """``hits``: one row per returned chunk. ``verdicts``: one row per query."""

    hits: DataFrame
    verdicts: DataFrame


def reject_queries(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split text bounds into usable queries and ``rejects(query_id, reason)``.
    ``since`` and ``until`` are text here: a year, a month or a day."""
    a, b = fx.date_bound(F.col("since"), False), fx.date_bound(F.col("until"), True)
    read = raw.withColumn("_a", a).withColumn("_b", b).withColumn(
        "reason",
        F.when(F.col("_a.rejected"), F.lit("bad_since"))
        .when(F.col("_b.rejected"), F.lit("bad_until"))
        .when(F.col("_a.bound") > F.col("_b.bound"), F.lit("reversed_range")))
    good = read.where(F.col("reason").isNull()).withColumn("since", F.col("_a.bound")).withColumn(
        "until", F.col("_b.bound")).drop("_a", "_b", "reason")
    return good, read.where(F.col("reason").isNotNull()).select("query_id", "reason")


def is_filtered(queries: DataFrame) -> bool:
    """Does any query carry a filter? Then the episode join is worth making."""
    q = vector.with_filters(queries)
    active = (F.nullif(tx.strip(F.col("guest")), F.lit("")).isNotNull()
              | F.col("since").isNotNull() | F.col("until").isNotNull())
    return not q.where(active).isEmpty()


def matching_queries(queries: DataFrame, episodes: DataFrame,
                     settings: Settings = DEFAULTS) -> DataFrame:
    """``query_id`` of the filtered queries at least one episode satisfies.

    Episodes are first reduced to distinct (guest, date). The distinct filters are
    shipped to that table in blocks of bounded size; a task marks which of them some
    row satisfies and sends each of those once, so no pair is ever a row.
    """
    q = vector.with_filters(queries).select(
        "query_id", F.nullif(F.lower(tx.strip(F.col("guest"))), F.lit("")).alias("guest"),
        vector.days("since").alias("since"), vector.days("until").alias("until"))
    q = q.where(F.col("guest").isNotNull() | F.col("since").isNotNull()
                | F.col("until").isNotNull())
    asked = q.withColumn("key", F.to_json(F.struct("guest", "since", "until")))
    places = episodes.select(F.lower("guest").alias("guest_key"), vector.days("publish_date").alias("day")).distinct()
    distinct = asked.select("key", "guest", "since", "until").distinct()
    n = max(1, -(-distinct.count() // settings.query_rows))
    seen = reduce(DataFrame.unionByName, [
        _satisfied(places, distinct.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i) if n > 1 else distinct) for i in range(n)])
    return asked.join(seen.distinct(), "key", "left_semi").select("query_id")


def _satisfied(places: DataFrame, filters: DataFrame) -> DataFrame:
    """``key`` of the filters that some row of ``places`` satisfies, once per task."""
    rules = filters.toArrow()
    column = {n: rules.column(n).to_pylist() for n in rules.schema.names}
    keys = column["key"]
    block = vector.QueryBlock(keys, np.zeros((len(keys), 0)), column["guest"], column["since"], column["until"])
    shared = places.sparkSession.sparkContext.broadcast(block)

    def mark(batches):
        block, hit = shared.value, np.zeros(len(shared.value.ids), bool)
        for batch in batches:
            day = batch.column("day").cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            hit |= block.allowed(batch.column("guest_key"), day).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, h in zip(block.ids, hit) if h], pa.string())], names=["key"])

    return places.mapInArrow(mark, "key string")


def fuse(vector_arm: DataFrame, text_arm: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, chunk_id, similarity, rank)`` and
    ``(query_id, chunk_id, score, rank)``; a missing side contributes nothing."""
    v = vector_arm.withColumnRenamed("rank", "_v")
    t = text_arm.withColumnRenamed("rank", "_t")
    part = lambda c: F.coalesce(1.0 / (settings.rrf_k + F.col(c)), F.lit(0.0))
    return v.join(t, ["query_id", "chunk_id"], "full_outer").select(
        "query_id", "chunk_id",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("score", F.lit(0.0)).alias("text_rank"),
        (part("_v") + part("_t")).alias("rrf_score"))


def cut(fused: DataFrame, queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The best ``top_k`` per query; zero or null means the default."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc("chunk_id"))
    out = fused.withColumn("rank", F.row_number().over(w))
    if "top_k" not in queries.columns:
        return out.where(F.col("rank") <= settings.top_k)
    k = F.coalesce(F.nullif(F.col("top_k"), F.lit(0)), F.lit(settings.top_k))
    return out.join(queries.select("query_id", k.alias("_k")), "query_id").where(
        F.col("rank") <= F.col("_k")).drop("_k")


def search(queries: DataFrame, chunks: DataFrame, episodes: DataFrame,
           settings: Settings = DEFAULTS, index: postings.Index | None = None,
           graph: Graph | None = None) -> Search:
    """``queries(query_id, query, vector[, guest, since, until, top_k])`` against
    ``chunks`` and ``episodes``; ``index`` is the stored keyword index (built for this
    search alone if there is none), and ``graph`` the stored neighbour graph, used where no
    query is filtered: a filter would leave too few of the nodes a search meets."""
    ensure_checkpoint_dir(chunks.sparkSession)
    # Both arms and every size check read the queries: materialised once.
    asked = stored(queries.where(tx.strip(F.coalesce("query", F.lit(""))) != ""), "asked")
    filtered = is_filtered(asked)
    reachable = asked
    unmatched = None
    if filtered:
        with_rules = vector.with_filters(asked)
        plain = (F.nullif(tx.strip(F.col("guest")), F.lit("")).isNull()
                 & F.col("since").isNull() & F.col("until").isNull())
        met = matching_queries(asked, episodes, settings)
        filtered_ids = with_rules.where(~plain).select("query_id")
        unmatched = stored(filtered_ids.join(met, "query_id", "left_anti"), "unmatched")
        reachable = stored(asked.join(unmatched, "query_id", "left_anti"), "reachable")
    located = chunks
    if filtered:
        located = chunks.select("chunk_id", "episode_id", "embedding", "is_sponsor").join(
            broadcast_if_small(episodes.select("episode_id", "guest", "publish_date"), settings), "episode_id")
    if graph is not None and not filtered:
        v = graph_search(reachable, graph, settings.pool, settings.graph_width)
    else:
        v = vector.nearest(reachable, located, settings.pool, settings, filtered=filtered)
    index = index or postings.build(chunks, fresh_path(chunks.sparkSession, "postings"))
    t = postings.ranked(reachable, index, episodes if filtered else None, settings.pool, settings)
    # At most top_k rows per query; verdicts, enrichment and size checks all read them.
    top = stored(cut(fuse(v, t, settings), reachable, settings), "top")
    return Search(top, verdicts(queries, top, unmatched, settings))


def verdicts(queries: DataFrame, hits: DataFrame, unmatched: DataFrame | None = None,
             settings: Settings = DEFAULTS) -> DataFrame:
    """Is the best similarity among the returned rows at the floor or above?"""
    best = hits.groupBy("query_id").agg(
        F.max("similarity").alias("_best"), F.count("*").alias("_n"))
    q = queries.select("query_id", (tx.strip(F.coalesce("query", F.lit(""))) == "").alias("_blank"))
    q = q.join(best, "query_id", "left")
    if unmatched is None:
        q = q.withColumn("_lost", F.lit(False))
    else:
        q = q.join(unmatched.select("query_id", F.lit(True).alias("_lost")), "query_id", "left")
    best_similarity = F.coalesce("_best", F.lit(0.0))
    grounded = F.coalesce(F.col("_n") > 0, F.lit(False)) & (
        best_similarity >= settings.similarity_floor)
    reason = (
        F.when(F.col("_blank"), F.lit("empty_query"))
        .when(F.coalesce("_lost", F.lit(False)), F.lit("no_matching_episodes"))
        .when(F.col("_n").isNull(), F.lit("no_results"))
        .when(~grounded, F.lit("below_similarity_threshold"))
        .otherwise(F.lit("")))
    return q.select("query_id", grounded.alias("grounded"),
                    best_similarity.alias("best_similarity"), reason.alias("reason"),
                    F.coalesce("_n", F.lit(0)).alias("n_hits"))


def enrich(hits: DataFrame, chunks: DataFrame, episodes: DataFrame,
           settings: Settings = DEFAULTS) -> DataFrame:
    """Hits with their chunk and episode columns. The hits are few, so they are
    the side that travels once counted. Their ids first thin out the chunks, below any
    join that ``chunks`` is made of, so that no other chunk's text is shuffled."""
    few = broadcast_if_small(hits, settings)
    ids = broadcast_if_small(stored(hits.select("chunk_id").distinct(), "ids"), settings)
    c = chunks.select("chunk_id", "episode_id", "speaker", "start_seconds", "end_seconds", "text").join(ids, "chunk_id", "left_semi")
    e = episodes.select("episode_id", "guest", "title", "youtube_url", "publish_date")
    found = few.join(c, "chunk_id")
    return broadcast_if_small(found, settings).join(e, "episode_id")


def citation() -> Column:
    """The citation struct over an enriched row."""
    return F.struct(
        F.col("chunk_id"),
        F.col("title").alias("episode_title"),
        F.col("guest"),
        tx.clock_label(F.col("start_seconds")).alias("timestamp"),
        fx.deep_link(F.col("youtube_url"), F.col("start_seconds")).alias("url"),
        F.col("publish_date").cast("string").alias("publish_date"),
        F.round("rrf_score", 5).alias("score"),
        F.round("similarity", 4).alias("similarity"))


def citations(enriched: DataFrame) -> DataFrame:
    return enriched.select("query_id", "rank", citation().alias("c")).select(
        "query_id", "rank", "c.*")


def debug_rows(enriched: DataFrame) -> DataFrame:
    """What an operator needs to tell a retrieval problem from a model problem."""
    return enriched.select(
        "query_id", "rank", citation().alias("c"), "speaker",
        F.substring("text", 1, 500).alias("excerpt"),
        F.round("text_rank", 5).alias("text_rank"),
    ).select("query_id", "rank", "c.*", "speaker", "excerpt", "text_rank")


def context_blocks(enriched: DataFrame, max_chars: int | None = None,
                   settings: Settings = DEFAULTS) -> DataFrame:
    """One numbered evidence text per query: the longest prefix of its ranked
    blocks within the budget. At most ``top_k`` rows meet per query."""
    budget = max_chars or settings.context_chars
    label = tx.clock_label(F.col("start_seconds"))
    stamp = F.when(label == "", F.lit("")).otherwise(F.concat(F.lit(" at "), label))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("guest"),
                     F.lit(" - "), F.col("title"), stamp, F.lit("\n"), F.col("text"))
    along = Window.partitionBy("query_id").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, 0)
    kept = enriched.select("query_id", "rank", block.alias("block")).withColumn(
        "_used", F.sum(F.length("block")).over(along)).where(F.col("_used") <= budget)
    return kept.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("bs")).select(
        "query_id", F.size("bs").alias("n_blocks"),
        F.array_join(F.col("bs.block"), "\n\n---\n\n").alias("context"))


def passage_summary(enriched: DataFrame, queries: DataFrame) -> DataFrame:
    """"N passages from M episodes (filters)" per query with hits."""
    q = vector.with_filters(queries).select(
        "query_id", fx.filter_text(F.col("guest"), F.col("since"), F.col("until")).alias("f"))
    n = enriched.groupBy("query_id").agg(
        F.count("*").alias("n"), F.countDistinct("title").alias("m"))
    plural = lambda c, w: F.concat(c.cast("string"), F.lit(f" {w}"),
                                   F.when(c == 1, F.lit("")).otherwise(F.lit("s")))
    scope = F.when(F.col("f") == "", F.lit("")).otherwise(
        F.concat(F.lit(" ("), F.col("f"), F.lit(")")))
    return n.join(q, "query_id").select("query_id", F.concat(
        plural(F.col("n"), "passage"), F.lit(" from "), plural(F.col("m"), "episode"),
        scope).alias("summary"))


def search_summary(queries: DataFrame, verdicts: DataFrame, enriched: DataFrame) -> DataFrame:
    """What a search came to, in a few words, for every query."""
    q = vector.with_filters(queries).select(
        "query_id", fx.filter_text(F.col("guest"), F.col("since"), F.col("until")).alias("f"))
    found = passage_summary(enriched, queries)
    missed = F.when(F.col("reason") == "no_matching_episodes",
                    F.concat(F.lit("no episode matches "), F.col("f"))).when(
        F.col("f") == "", F.lit("nothing relevant found")).otherwise(
        F.concat(F.lit("nothing relevant found ("), F.col("f"), F.lit(")")))
    return verdicts.join(q, "query_id").join(found, "query_id", "left").select(
        "query_id", F.when(F.col("grounded"), F.col("summary")).otherwise(missed).alias("summary"))


# What joins several people in one guest field.
GUEST_JOINERS = r"(?U)\s*(?:\+|,|&|\band\b)\s*"


def guest_names(episodes: DataFrame) -> DataFrame:
    """Each person of every guest field who is given with more than one word."""
    each = episodes.select("guest").distinct().select(
        F.explode(F.split("guest", GUEST_JOINERS)).alias("name"))
    return each.select(tx.strip(F.col("name")).alias("name")).where(
        F.contains("name", F.lit(" "))).distinct()


def guests_named(messages: DataFrame, episodes: DataFrame,
                 settings: Settings = DEFAULTS) -> DataFrame:
    """``message_id, name`` for every known guest a message names in full.

    A message with a name has the name's words in a row, so messages and names
    meet on the name's longest pair of neighbouring words (or its only word), and
    only those pairs are compared.
    """
    names = guest_names(episodes).withColumn("_ws", _words("name")).select(
        "name", F.explode(F.when(F.size("_ws") > 1, _pairs("_ws")).otherwise(
            F.coalesce(F.nullif(F.col("_ws"), F.array().cast("array<string>")),
                       F.array(F.lit(""))))).alias("_key"))
    names = names.groupBy("name").agg(F.max_by("_key", F.struct(F.length("_key"), "_key")).alias("_key"))
    said = messages.select("message_id", _words("message").alias("_ws")).select(
        "message_id", F.explode(F.array_distinct(F.concat(
            F.array(F.lit("")), "_ws", _pairs("_ws")))).alias("_key"))
    maybe = said.join(broadcast_if_small(names, settings), "_key").select("message_id", "name")
    pairs = messages.select("message_id", "message").join(maybe, "message_id")
    whole = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.col("name"), F.lit(r"\E(?!\w)"))
    return pairs.where(F.regexp_like("message", whole)).select("message_id", "name")


def _words(column: str) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(r"(?U)\w+"), F.lit(0))


def _pairs(words: str) -> Column:
    both = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                      F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, both).otherwise(F.array().cast("array<string>"))


def single_guest(messages: DataFrame, episodes: DataFrame,
                 settings: Settings = DEFAULTS) -> DataFrame:
    """The guest to filter by: set only where a message names exactly one."""
    named = guests_named(messages, episodes, settings).groupBy("message_id").agg(
        F.count("*").alias("n_named"), F.min("name").alias("_name"))
    return messages.select("message_id").join(named, "message_id", "left").select(
        "message_id", F.coalesce("n_named", F.lit(0)).alias("n_named"),
        F.when(F.col("n_named") == 1, F.col("_name")).alias("guest"))


def with_detected_guest(queries: DataFrame, episodes: DataFrame,
                        settings: Settings = DEFAULTS) -> DataFrame:
    """Queries whose ``guest`` is filled in from the user's own ``message`` where
    none was given and the message names exactly one."""
    q = vector.with_filters(queries)
    named = single_guest(q.select(F.col("query_id").alias("message_id"), "message"), episodes,
                         settings).select(F.col("message_id").alias("query_id"),
                                          F.col("guest").alias("_named"))
    given = F.nullif(tx.strip(F.col("guest")), F.lit(""))
    return q.join(named, "query_id", "left").withColumn(
        "guest", F.coalesce(given, "_named")).drop("_named")
