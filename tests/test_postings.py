"""The positional index: packing, matching, ranks and pruning against plain models."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.operators import postings
from turnstone.settings import DEFAULTS, Settings

WORDS = ["price", "zebra", "growth", "loop", "team", "hire", "plan", "cost", "ship", "book"]


def corpus(spark, texts, **more):
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id long, episode_id long, text string")
    return df.withColumns(more)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def random_texts(n, seed=0, longest=60):
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, len(WORDS) + 1)
    return [" ".join(rng.choice(WORDS, rng.integers(0, longest), p=weights / weights.sum())) for _ in range(n)]


def model(texts, query, weight=0.0):
    """(chunk, score) of every chunk with all words, by the formula."""
    bags = [[w for w in t.split() if w not in ("the", "and", "of")] for t in texts]
    mean, n = sum(map(len, bags)) / len(bags), len(bags)
    df = Counter(w for b in bags for w in set(b))
    out = []
    for i, b in enumerate(bags):
        terms, tf = set(query.split()), Counter(b)
        if terms <= set(b):
            score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in terms)
            if weight:
                near = sum(min(1.0, 16 / s) for s in spans(b, terms))
                score *= 1 + weight * near / (1 + near)
            out.append((i, round(round(score, 9), 6)))
    return sorted(out, key=lambda r: (-r[1], r[0]))


def spans(words, terms):
    """Lengths of the smallest stretches with all terms, found by trying every stretch."""
    holds = lambda a, b: terms <= set(words[a:b + 1])
    return [b - a + 1 for a in range(len(words)) for b in range(a, len(words))
            if holds(a, b) and not (a < b and (holds(a + 1, b) or holds(a, b - 1)))]


@given(st.lists(st.integers(0, 2**40), max_size=300))
def test_packed_numbers_come_back(values):
    data, start = postings.pack(np.array(values, np.int64))
    assert postings.unpack(data.tobytes()).tolist() == values and len(start) == len(values) + 1


@settings(max_examples=200)
@given(st.lists(st.sampled_from("abcx"), min_size=3, max_size=40))
def test_covers_are_the_smallest_spans(words):
    terms = set("abc")
    if terms <= set(words):
        at = [np.array([i for i, w in enumerate(words) if w == t]) for t in sorted(terms)]
        assert sorted(postings.covers(at).tolist()) == sorted(spans(words, terms))


@settings(max_examples=100)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 6), st.integers(1, 9)), min_size=1, max_size=40))
def test_unbeaten_pairs_hold_the_best_score_under_any_average(rows):
    rows.sort(key=lambda r: r[0])
    numbers = {b: i for i, b in enumerate(dict.fromkeys(r[0] for r in rows))}
    block, tf, length = (np.array(c) for c in zip(*[(numbers[b], t, max(t, n)) for b, t, n in rows]))
    best_tf, best_length, of = postings._unbeaten(block, tf, length)
    for mean in (0.5, 3.0, 50.0):
        scorer = postings.Scorer(10, mean, DEFAULTS)
        for b in set(block.tolist()):
            assert scorer.weight(tf[block == b], length[block == b]).max() == pytest.approx(
                scorer.weight(best_tf[of == b], best_length[of == b]).max())


QUERIES = ["price", "price zebra", "growth loop team", "book", "hire plan cost ship", "zebra missing", "the of", "price price"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    texts = random_texts(700) + ["", "the and of", "price " * 300] + ["zebra growth"] * 40
    return texts, postings.build(corpus(spark, texts), str(tmp_path_factory.mktemp("postings")))


def test_matches_and_scores(spark, indexed):
    texts, index = indexed
    got = {}
    for r in postings.search(asked(spark, *QUERIES), index).collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    for i, q in enumerate(QUERIES):
        assert sorted(got.get(i, []), key=lambda r: (-r[1], r[0])) == ([] if q == "the of" else model(texts, q)), q


@pytest.mark.parametrize("weight", [0.0, 1.0])
@pytest.mark.parametrize("pool", [1, 7, 30])
def test_best_few_equal_the_exhaustive_ranking(spark, indexed, weight, pool):
    texts, index = indexed
    found = postings.ranked(asked(spark, *QUERIES[:5]), index, pool=pool, settings=Settings(closeness_weight=weight))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    for i, q in enumerate(QUERIES[:5]):
        assert got.get(i, []) == model(texts, q, weight)[:pool], q


def test_frequent_words_are_not_scored_whole(spark, tmp_path):
    """Same 30 as the exhaustive ranking, with under a tenth of the matches scored."""
    texts = random_texts(40_000, seed=3, longest=40)
    index = postings.build(corpus(spark, texts), str(tmp_path / "one"))
    q = asked(spark, "price", "zebra", "price zebra")
    every = {r.query_id: r.n for r in postings.search(q, index).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    few = postings.search(q, index, 30)
    scored = {r.query_id: r.n for r in few.join(index.docs, "chunk_id").select("query_id", "slice", "scored").distinct().groupBy(
        "query_id").agg(F.sum("scored").alias("n")).collect()}
    for i, query in enumerate(("price", "zebra", "price zebra")):
        top = sorted(((round(r.score, 6), r.chunk_id) for r in few.where(F.col("query_id") == i).collect()), key=lambda r: (-r[0], r[1]))[:30]
        assert [(c, s) for s, c in top] == model(texts, query)[:30]
    assert every[0] > 30_000 and scored[0] < 0.1 * every[0] and scored[1] < 0.1 * every[1] and scored[2] < every[2]


def test_positions(spark, tmp_path):
    """Stop words keep their place between terms, as they do in the text."""
    index = postings.build(corpus(spark, ["growth of the loop", "loop x y z growth loop", "loops growing"]), str(tmp_path / "p"))
    got = {(r.chunk_id, r.n_covers, r.shortest) for r in postings.search(asked(spark, "growth loops"), index, spans=True).collect()}
    assert got == {(0, 1, 4), (1, 2, 2)}


def test_only_the_stems_folders_are_read(spark, indexed):
    _, index = indexed
    bucket = spark.createDataFrame([("zebra",)], "term string").select(postings.bucket()).first()[0]
    blocks = postings.wanted_blocks(index, [("zebra", bucket)])
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.term for r in blocks.select("term").distinct().collect()} == {"zebra"}


def test_segments_and_chunks_taken_out(spark, tmp_path):
    root = str(tmp_path / "s")
    postings.build(corpus(spark, ["price one", "price two"]), root, "a")
    index = postings.build(corpus(spark, ["price three", "zebra"]).withColumn("chunk_id", F.col("chunk_id") + 10), root, "b")
    q = asked(spark, "price")
    ids = lambda index: sorted(r.chunk_id for r in postings.ranked(q, index).collect())
    assert ids(index) == [0, 1, 10]
    assert ids(postings.Index(index.blocks, index.docs.where("chunk_id <> 1"))) == [0, 10]
    assert ids(postings.Index(index.blocks, index.docs.where("segment = 'b'"))) == [10]


def test_odd_tables(spark, tmp_path):
    none = postings.build(corpus(spark, []), str(tmp_path / "none"))
    assert postings.search(asked(spark, "price"), none).count() == 0
    texts = [None, "", "the", "Price PRICED", "prix élevé über 2024"]
    odd = postings.build(corpus(spark, texts, is_sponsor=F.col("chunk_id") == 99), str(tmp_path / "odd"))
    assert odd.docs.count() == 5 and [r.n for r in odd.blocks.where("term = 'price'").collect()] == [1]
    got = {(r.query_id, r.chunk_id) for r in postings.search(asked(spark, "pricing", "ÉLEVÉ 2024", "", "the"), odd).collect()}
    assert got == {(0, 3), (1, 4)}
    ads = postings.build(corpus(spark, ["price", "price"], is_sponsor=F.col("chunk_id") == 0), str(tmp_path / "ads"))
    assert [r.chunk_id for r in postings.search(asked(spark, "price"), ads).collect()] == [1]


def test_query_blocks(spark, indexed):
    _, index = indexed
    q = asked(spark, *QUERIES)
    rows = lambda s: sorted(map(str, postings.search(q, index, settings=s).collect()))
    assert rows(Settings(query_rows=1)) == rows(DEFAULTS)


def test_blocks_come_from_a_slice_at_once():
    """Chunks in any order, an empty and a null one, two words with one stem, a stop word."""
    import pyarrow as pa

    bags = pa.table({"slice": [3] * 4, "length": [3, 0, 2, 0], "chunk_id": [7, 9, 8, 6], "same": [1, 2, 3, 4],
                     "words": ["loops the loop x", "", "x loop", None]})
    known = pa.table({"slice": [3] * 3, "term": ["loop", "loops", "x"], "stem": ["loop", "loop", "x"]})
    got = {r["term"]: r for r in postings._packed(bags, known).to_pylist()}
    assert set(got) == {"loop", "x"} and all(r["slice"] == 3 and (r["lo"], r["hi"], r["n"]) == (2, 3, 2) for r in got.values())
    read = lambda term, c: postings.unpack(got[term][c]).tolist()
    assert (read("loop", "docs"), read("loop", "counts"), read("loop", "lengths"), read("loop", "positions")) == ([0, 1], [1, 2], [2, 3], [1, 0, 2])
    assert read("x", "positions") == [0, 3]
