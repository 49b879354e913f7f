"""Retrieval behaviour on literal tables with synthetic vectors."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.functions import search as fx
from turnstone.functions import text as tx
from turnstone.operators import hybrid, postings, vector
from turnstone.operators.tables import fresh_path
from turnstone.plans.catalog import search as registered
from turnstone.plans.catalog import tables
from turnstone.settings import Settings

SMALL = Settings(query_rows=3)


def axis(i, second=None, dim=8):
    v = [0.0] * dim
    v[i] = 1.0
    if second is not None:
        v[second] = 0.5
    return v


def make(spark, chunks, episodes, queries):
    c = spark.createDataFrame(chunks, "chunk_id string, episode_id string, speaker string, start_seconds int, "
                              "end_seconds int, text string, is_sponsor boolean, embedding array<float>")
    e = spark.createDataFrame(episodes, "episode_id string, guest string, title string, youtube_url string, publish_date date")
    q = spark.createDataFrame(queries, "query_id string, query string, vector array<float>, guest string, since date, "
                              "until date, top_k int")
    return c, e, q


EPISODES = [
    ("e1", "Ana Bell", "Pricing", "https://v.test/watch?v=1", date(2023, 5, 17)),
    ("e2", "Rex Moor + Ana Bell", "Growth", "", date(2024, 1, 1)),
    ("e3", "Casey Park", "Hiring", "https://v.test/3", None),
]
CHUNKS = [
    ("c1", "e1", "Ana", 120, 130, "how to price a product", False, axis(0, 1)),
    ("c2", "e1", "Ana", None, None, "zebra onboarding", False, axis(2)),
    ("c3", "e2", "Rex", 3725, 3726, "growth loops and retention", False, axis(3)),
    ("c4", "e3", "Casey", 5, 6, "hiring the first manager", False, axis(4)),
    ("ad", "e1", "Ana", 0, 0, "how to price a product ad", True, axis(0)),
]
NONE = (None, None, None, None)


def test_verdicts_and_reasons(spark):
    c, e, q = make(spark, CHUNKS, EPISODES, [
        ("near", "price product", axis(0), *NONE), ("far", "sourdough", axis(7), *NONE),
        ("blank", "  ", axis(0), *NONE), ("rare", "zebra", axis(7), *NONE),
        ("nobody", "price", axis(0), "Zoe", None, None, None), ("wild", "price", axis(0), "%", None, None, None),
        ("joint", "growth", axis(3), "ana BELL", None, None, None),
        ("undated", "hiring", axis(4), None, date(1990, 1, 1), date(2030, 1, 1), None),
        ("dated", "price product", axis(0), None, date(2023, 5, 17), date(2023, 5, 17), 1)])
    found = hybrid.search(q, c, e)
    v = {r.query_id: r for r in found.verdicts.collect()}
    hits = {}
    for r in found.hits.collect():
        hits.setdefault(r.query_id, {})[r.chunk_id] = r
    assert v["near"].grounded and v["near"].reason == ""
    assert (v["far"].grounded, v["far"].reason) == (False, "below_similarity_threshold")
    assert v["blank"].reason == "empty_query"
    assert v["nobody"].reason == v["wild"].reason == "no_matching_episodes"
    assert "nobody" not in hits and "wild" not in hits
    assert all("ad" not in h for h in hits.values())
    assert hits["rare"]["c2"].text_rank > 0
    assert set(hits["joint"]) == {"c1", "c2", "c3"} and v["joint"].grounded
    assert "c4" not in hits["undated"]
    assert list(hits["dated"]) == ["c1"]


def test_empty_corpus(spark):
    c, e, q = make(spark, [], [], [("q", "anything", axis(0), *NONE)])
    assert hybrid.search(q, c, e).verdicts.first().reason == "no_results"


def test_filter_applies_before_the_pool_is_cut(spark):
    closer = [(f"x{i:02d}", "e1", "A", 1, 1, "price", False, axis(0, 1)) for i in range(35)]
    wanted = [("w", "e3", "C", 1, 1, "other words", False, axis(0, 5))]
    c, e, q = make(spark, closer + wanted, EPISODES, [("q", "price", axis(0, 1), "casey", None, None, None)])
    assert [r.chunk_id for r in hybrid.search(q, c, e).hits.collect()] == ["w"]


def test_keyword_hits_can_push_the_best_vector_hit_out(spark):
    # x is first by text and second by vector; n is first by vector only.
    c, e, q = make(spark, [("n", "e1", "A", 1, 1, "nothing", False, axis(0)),
                           ("x", "e1", "A", 1, 1, "zebra", False, axis(5))], EPISODES,
                   [("q1", "zebra", axis(0), None, None, None, 1), ("q8", "zebra", axis(0), *NONE)])
    v = {r.query_id: r.grounded for r in hybrid.search(q, c, e).verdicts.collect()}
    assert v == {"q1": False, "q8": True}


def test_stop_words_only_match_nothing(spark):
    c, e, q = make(spark, CHUNKS, EPISODES, [("q", "how to the", axis(0), *NONE)])
    assert postings.search(q, postings.build(c, fresh_path(spark, "postings"))).count() == 0


def test_shaping(spark):
    c, e, q = make(spark, CHUNKS, EPISODES, [("q", "growth loops", axis(3), *NONE)])
    enriched = hybrid.enrich(hybrid.search(q, c, e).hits, c, e)
    cites = {r.chunk_id: r for r in hybrid.citations(enriched).collect()}
    assert (cites["c3"].timestamp, cites["c3"].url) == ("1:02:05", "")
    assert (cites["c1"].timestamp, cites["c1"].url) == ("2:00", "https://v.test/watch?v=1&t=120")
    assert (cites["c2"].timestamp, cites["c2"].url) == ("", "https://v.test/watch?v=1")
    assert cites["c4"].url == "https://v.test/3?t=5"
    blocks = hybrid.context_blocks(enriched, 100).first()
    assert blocks.n_blocks == 1 and blocks.context.startswith("[1] Rex Moor + Ana Bell - Growth at 1:02:05\ngrowth")
    assert hybrid.passage_summary(enriched, q).first().summary == "4 passages from 3 episodes"


def test_hits_thin_out_the_chunks_before_other_joins(spark):
    """Chunks made by a join of texts to vectors: only the texts of hits reach that join."""
    c, e, q = make(spark, CHUNKS, EPISODES, [("q", "growth loops", axis(3), *NONE)])
    hits = hybrid.search(q, c, e).hits
    want = hybrid.enrich(hits, c, e).collect()
    joined = c.drop("embedding").join(c.select("chunk_id", "embedding"), "chunk_id", "left")
    got = hybrid.enrich(hits, joined, e)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and plan.index("Join LeftSemi") > plan.index("Join LeftOuter")
    assert sorted(map(str, got.collect())) == sorted(map(str, want))


def test_texts_of_chunks_repeat_as_their_vectors_do(spark, tmp_path):
    docs = spark.createDataFrame([(1, "src1", "a License"), (2, "src2", "b"), (2, "src2", "b"), (3, None, None), (None, "src4", "d")],
                                 "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [0.5]) for i in (1, 1, 1, 2, 2, 4, None, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, got = (t(spark, str(tmp_path)) for t in (tables.chunks, tables.chunk_texts))
    assert got.columns == [x for x in want.columns if x != "embedding"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.drop("embedding").collect())) and got.count() == 9


def brute(q, c, k):
    q, c = np.array(q, float), np.array(c, float)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    s = np.round(q @ c.T, 9)
    return {(i, int(j), r + 1) for i in range(len(q))
            for r, j in enumerate(np.lexsort((np.arange(len(c)), -s[i]))[:k])}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(700, 6)).astype("float32")
    c[100:400] = c[100]  # a third of the rows are one vector: ties all the way
    q = np.vstack([rng.normal(size=(9, 6)), c[100:101]]).astype("float32")
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "chunk_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<float>")
    return queries, chunks, brute(q, c, 30)


@pytest.mark.parametrize("settings", [Settings(), SMALL])
def test_exact_search_matches_brute_force_on_both_paths(cloud, settings):
    queries, chunks, want = cloud
    got = vector.nearest(queries, chunks, 30, settings).collect()
    assert {(r.query_id, r.chunk_id, r.rank) for r in got} == want


def test_block_path_with_filters(spark):
    c, e, q = make(spark, CHUNKS, EPISODES, [
        (f"q{i}", "x", axis(i % 5), "ana" if i % 2 else None, None, date(2023, 12, 31) if i % 3 == 0 else None, None)
        for i in range(12)])
    located = c.join(e, "episode_id")
    key = lambda df: {(r.query_id, r.chunk_id, r.rank) for r in df.collect()}
    assert key(vector.nearest(q, located, 2)) == key(vector.nearest(q, located, 2, SMALL))


def test_probed_search_recall(cloud):
    queries, chunks, want = cloud
    centres = vector.train_lists(chunks, 8)
    listed = vector.assign_lists(chunks, centres)
    key = lambda df: {(r.query_id, r.chunk_id, r.rank) for r in df.collect()}
    assert key(vector.nearest_probed(queries, listed, centres, 8, 30)) == want
    some = {(a, b) for a, b, _ in key(vector.nearest_probed(queries, listed, centres, 4, 30))}
    assert len(some & {(a, b) for a, b, _ in want}) / len(want) > 0.6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_probed_search_keeps_its_recall(spark, sf):
    pairs = lambda fn: {(r.query_id, r.chunk_id) for r in fn(spark, f"/root/testdata/{sf}").collect()}
    want = pairs(registered.knn_exact)
    assert len(pairs(registered.knn_probed) & want) / len(want) >= 0.9


def test_many_filters_go_in_blocks(spark):
    _, e, q = make(spark, CHUNKS, EPISODES, [
        (f"q{i}", "x", axis(0), g, None, None, None)
        for i, g in enumerate(["ana", "rex", "casey", "zoe", "bell", "moor", "nobody", "a"])])
    got = {r.query_id for r in hybrid.matching_queries(q, e, Settings(query_rows=2)).collect()}
    assert got == {"q0", "q1", "q2", "q4", "q5", "q7"}


def test_date_bounds(spark):
    rows = [("2023", False, "2023-01-01"), ("2023", True, "2023-12-31"), ("2023-5", False, "2023-05-01"),
            ("2023-02", True, "2023-02-28"), ("2024-02", True, "2024-02-29"), ("2023-05-17", True, "2023-05-17"),
            (" 2023-5-7 ", False, "2023-05-07"), ("", True, None), (None, False, None)]
    bad = ["2023-13", "2023-02-30", "soon", "23", "2023/05"]
    df = spark.createDataFrame([(v, e) for v, e, _ in rows] + [(v, False) for v in bad], "v string, e boolean")
    got = [r.b for r in df.select(fx.date_bound(F.col("v"), F.col("e")).alias("b")).collect()]
    assert [(str(g.bound) if g.bound else None, g.rejected) for g in got] == [
        (w, False) for _, _, w in rows] + [(None, True)] * len(bad)


def test_rejected_queries(spark):
    raw = spark.createDataFrame([("a", "2023", "2022"), ("b", "x", None), ("c", None, "y"), ("d", "2022", "2023")],
                                "query_id string, since string, until string")
    good, bad = hybrid.reject_queries(raw)
    assert {(r.query_id, r.reason) for r in bad.collect()} == {
        ("a", "reversed_range"), ("b", "bad_since"), ("c", "bad_until")}
    assert str(good.first().until) == "2023-12-31"


def test_guests_in_messages(spark):
    eps = spark.createDataFrame([("Ana Bell",), ("Rex Moor + Jo Li",), ("Adam",), ("Ed O'Neil & Mo (X) Ray",), ("A -",)], "guest string")
    said = ["what did ana bell say", "Compare Ana Bell and Rex Moor", "ask Adam", "Anabell", "Joana Bell", "jo li's view",
            "Ed O'Neil?", "mo (x) ray", "ana  bell", None, "an a - here"]
    msgs = spark.createDataFrame(list(enumerate(said)), "message_id int, message string")
    got = {}
    for r in hybrid.guests_named(msgs, eps).collect():
        got.setdefault(r.message_id, set()).add(r.name)
    assert got == {0: {"Ana Bell"}, 1: {"Ana Bell", "Rex Moor"}, 5: {"Jo Li"}, 6: {"Ed O'Neil"}, 7: {"Mo (X) Ray"}, 10: {"A -"}}
    one = {r.message_id: r.guest for r in hybrid.single_guest(msgs, eps).collect()}
    assert one[0] == "Ana Bell" and one[1] is None


def test_guest_taken_from_the_message(spark):
    eps = spark.createDataFrame([("Ana Bell",), ("Rex Moor",)], "guest string")
    q = spark.createDataFrame([("a", "ask ana bell", None), ("b", "ask ana bell", "Rex"), ("c", "ana bell or rex moor", "")],
                              "query_id string, message string, guest string")
    assert {r.query_id: r.guest for r in hybrid.with_detected_guest(q, eps).collect()} == {"a": "Ana Bell", "b": "Rex", "c": None}


def test_date_phrases(spark):
    df = spark.createDataFrame([("since 2023",), ("after 2023 and before 2025",), ("UNTIL 2024",), ("in 2023",)], "q string")
    got = [tuple(r.d) for r in df.select(fx.date_phrases(F.col("q")).alias("d")).collect()]
    assert got == [("2023", None), ("2024", "2024"), (None, "2024"), (None, None)]


def test_token_estimate_matches_rule(spark):
    df = spark.range(0, 3000).select(F.repeat(F.lit("w "), F.col("id").cast("int")).alias("t"), "id")
    got = {r.id: r.n for r in df.select("id", tx.token_estimate(F.col("t")).alias("n")).collect()}
    assert got == {n: max(1, int(n * 1.3)) for n in range(3000)}


def test_terms_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    from turnstone.operators import keyword

    monkeypatch.setattr(keyword, "PART_BYTES", 64)
    chunks = spark.range(40).selectExpr("id AS chunk_id", "concat('loops loop price', id) AS text")
    table = keyword.term_table(chunks)
    assert table.rdd.getNumPartitions() >= 10
    assert {(r.chunk_id, r.length, r.tf) for r in table.where("term = 'loop'").collect()} == {(i, 3, 2) for i in range(40)}


def test_transcripts_are_packed_a_few_at_a_time():
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    from turnstone.operators import pack

    schema = to_arrow_schema(T.StructType([T.StructField("k", T.LongType()), T.StructField("chunks", pack.CHUNKS)]))
    turn = [{"speaker": "A", "start_seconds": 1, "text": "one two", "is_sponsor": False}]
    batch = pa.RecordBatch.from_pydict({"k": list(range(100)), "turns": [turn if i % 9 else None for i in range(100)]})
    made = list(pack._per_batch(["k"], schema, 60, 20)([batch]))
    assert max(b.num_rows for b in made) <= pack.AT_ONCE and [k for b in made for k in b.column("k").to_pylist()] == list(range(100))
    assert [len(c) for b in made for c in b.column("chunks").to_pylist()] == [1 if i % 9 else 0 for i in range(100)]
