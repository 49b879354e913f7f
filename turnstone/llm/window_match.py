"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``size`` consecutive words (a shorter item is one
window). A window is a set of word shingles, ordered by their rarity in the
documents. Containment asks for all of them, so the necessary prefix is one
shingle: the rarest. Document positions are joined to windows on it; the shingle's
offset gives the only start that is possible, which must leave room for the
window (positional and length bounds), and the words there are compared exactly.

Only DataFrame functions: documents are exploded to positions inside one code
generation span, where only matching positions become rows.

Cases. Null, empty and wordless texts: 0 words, no hit. Long texts are searched
whole. Repeated documents are judged each alike; repeated items each count, under
their own ids. Empty tables: empty result, or no hits. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import lower_ascii, written
from turnstone.operators.bounds import fits

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words_of(text: Column) -> Column:
    """Words of the lower-cased text; null has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.array_remove(parts, "")


def _shingle_at(words: Column, position: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, position + k) for k in range(length)], F.lit(length))


def windows(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """Distinct windows: words, length."""
    cut = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return cut.select("item_id", F.explode(starts).alias("start"), "words").select(
        "item_id", F.slice("words", F.col("start") + 1, F.lit(size)).alias("window"))


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Every (position, shingle) of every document, its words at hand."""
    at = docs.where(F.size("words") > 0).select("key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))
    hashes = [F.when(F.col("at") + n <= F.size("words"), _shingle_at(F.col("words"), F.col("at"), n)) for n in lengths]
    if len(hashes) == 1:
        return at.withColumn("shingle", hashes[0]).where("shingle is not null")
    many = at.withColumn("shingle", F.explode(F.array(*hashes)))
    return many.where("shingle is not null")


def judge(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20,
          doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return judge_texts(docs, items, size, share, doc_id, text, item_id, item_text).drop("md5")


def judge_texts(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20,
                doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``judge`` with the md5 of the text: an id may repeat, or be null, with other texts.

    Both uses of the windows' shingles broadcast them only if a count shows them
    small; beyond that the positions shuffle by shingle, without their words, and the
    few that pass the bounds fetch their document again."""
    cut = written(windows(items, size, item_id, item_text), "windows")
    one = written(cut.select("window").distinct().withColumn("length", F.size("window")), "window")
    offsets = one.select("window", "length", F.least(F.lit(SHINGLE), F.col("length")).alias("n")).withColumn(
        "offset", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("n"))))
    lengths = sorted(r.n for r in offsets.select("n").distinct().collect()) or [SHINGLE]  # at most SHINGLE values
    hashed = offsets.withColumn("shingle", F.coalesce(*[
        F.when(F.col("n") == n, _shingle_at(F.col("window"), F.col("offset"), n)) for n in lengths]))
    hashed = written(hashed.groupBy("window", "length", "shingle").agg(F.min("offset").alias("offset")), "shingles")

    text_col = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_col.alias("text"))
    key = F.struct("doc_id", F.md5("text").alias("md5"))
    worded = rows.select(key.alias("key"), words_of(F.col("text")).alias("words"))

    wanted = hashed.select("shingle").distinct()
    small = fits(wanted)
    seen = _positions(worded, lengths).select("shingle").join(F.broadcast(wanted) if small else wanted, "shingle")
    rarity = seen.groupBy("shingle").agg(F.count("*").alias("n_docs"))
    ranked = hashed.join(rarity, "shingle")  # a window with an unseen shingle occurs nowhere
    all_of = hashed.groupBy("window").agg(F.count("*").alias("shingles"))
    rarest = ranked.groupBy("window").agg(
        F.min(F.struct("n_docs", "shingle", "offset", "length")).alias("r"), F.count("*").alias("seen"))
    prefix = written(rarest.join(all_of, "window").where("seen = shingles").select(
        "window", F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset"), F.col("r.length").alias("length")), "prefix")

    start = (F.col("at") - F.col("offset")).alias("start")
    bounds = (F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("length") <= F.size("words"))
    if fits(prefix):
        met = _positions(worded, lengths).join(F.broadcast(prefix), "shingle").where(bounds)
        hits = met.where(F.slice("words", F.col("at") - F.col("offset") + 1, F.col("length")) == F.col("window"))
        hits = hits.select("key", start, "length", "window")
    else:
        met = _positions(worded, lengths).select("key", "at", F.size("words").alias("n"), "shingle").join(prefix, "shingle")
        met = met.where((F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("length") <= F.col("n")))
        hits = met.select("key", start, "length", "window").join(worded.dropDuplicates(["key"]), "key").where(
            F.slice("words", F.col("start") + 1, F.col("length")) == F.col("window")).select("key", "start", "length", "window")
    hits = written(hits.distinct(), "hits")
    return _summed(rows, hits, cut, key, share)


def _summed(rows: DataFrame, hits: DataFrame, cut: DataFrame, key: Column, share: int) -> DataFrame:
    """Covered words and items per document. A document's hits are at most its words."""
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    step = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], s["start"] + s["length"]).alias("to")))
    covered = spans.select("key", step["n"].cast("long").alias("n_hit"))
    found = hits.select("key", "window").distinct().join(cut.select("window", "item_id").distinct(), "window")
    named = found.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_key = covered.join(named, "key")
    base = rows.select("doc_id", key.alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    md5 = base["key"]["md5"]
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(per_key, base["key"].eqNullSafe(per_key["key"]), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), md5.alias("md5"))
