"""The ten operators: against plain models, on awkward rows, on empty tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import BODY, documents, empty, rows
from oracle import compare, connect
from pyspark.sql import functions as F

from turnstone.llm import (attention_quality, components, heavy_dedup, hilbert_shards, order_minhash, pitman_yor, queries,
                           rank_queue_bpe, secret_scan, token_counts, url_rules, window_match)
from turnstone.llm.common import shared_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given_docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    message, _ = compare(spark, connect(SF), name, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert message is None, message


def ordered(rows):
    return sorted(map(str, rows))


# 1 shards

def test_curve_is_a_path():
    """Every cell once, and neighbours on the curve are neighbours in space."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = hilbert_shards.curve_index(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        walk = cells[np.argsort(at)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", hilbert_shards.LAWS)
def test_shards(spark, law):
    docs = documents(spark)
    dims = [F.col("lang"), F.col("n_chars")]
    got = hilbert_shards.assign(docs, dims, law=law, shards=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if law == "rows":
        counts = [len(slots[s]) for s in range(4)]
        assert max(counts) - min(counts) <= 1
    want = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows())
    assert Counter((r.size, r.text_crc32) for r in got) == want
    assert hilbert_shards.assign(empty(spark), dims).count() == 0


def test_shards_follow_a_plain_model(spark):
    """Cells by ranks of the texts and numbers, sorted by curve, id and checksum, cut at equal counts."""
    rng = random.Random(4)
    names = [f"https://crawl.example/part-{i:02d}" for i in range(8)]
    data = [(i, "t" * rng.randrange(9), names[i % 8], rng.randrange(1000)) for i in range(160)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n long").repartition(5)
    got = {r.doc_id: r for r in hilbert_shards.assign(df, [F.col("source"), F.col("doc_id")], shards=3, bits=3).collect()}
    cells = np.array([[names.index(s), i * 8 // 160] for i, _, s, _ in data])
    curve = hilbert_shards.curve_index(cells, 3)
    order = sorted(range(160), key=lambda i: (curve[i], i))
    shard = [k * 3 // 160 for k in range(160)]
    for k, i in enumerate(order):
        assert (got[i].curve, got[i].shard, got[i].slot) == (curve[i], shard[k], k - shard.index(shard[k])), i


def test_texts_are_cut_by_their_ranks(spark):
    df = spark.createDataFrame([(f"same-long-prefix-{i % 50:03d}",) for i in range(500)] + [("hot",)] * 250, "s string")
    cuts = hilbert_shards.text_cuts(df.repartition(7), "s", 6)
    assert cuts == ["hot", "same-long-prefix-012", "same-long-prefix-024", "same-long-prefix-037"]
    assert hilbert_shards.text_cuts(df.where("false"), "s", 6) == []


def test_shards_in_bytes_are_near_equal(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = hilbert_shards.assign(docs, [F.col("lang"), F.col("n_chars")], law="bytes").collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)


def test_manifest_prunes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = queries.op1_hilbert_shards(spark, SF).join(docs.select("doc_id", "lang", "source"), "doc_id")
    runs = hilbert_shards.manifest(placed, {"lang": F.col("lang"), "size": F.col("size")}, run_rows=10).cache()
    kept = hilbert_shards.prune(runs, {"lang": "fr", "size": 3000}, {"lang": "fr"})
    rows_in = placed.where("lang = 'fr' and size >= 3000").selectExpr("shard", "slot div 10 as run").distinct()
    assert rows_in.join(kept, ["shard", "run"], "left_anti").count() == 0
    assert kept.count() < runs.count()


# 2 near-duplicates

def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(0, 12))
def test_banded_alignment(a, b, limit):
    want = plain_edits(a, b)
    got = order_minhash.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), limit)
    assert got == (want if want <= limit else None)


@given(st.lists(st.integers(0, 30), max_size=30), st.lists(st.integers(0, 30), max_size=30))
def test_word_bits_never_say_more_edits_than_there_are(a, b):
    """The bounds that spare an alignment hold for any two texts."""
    a, b = (np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (a, b))
    edits = order_minhash.edits_within(a, b, 60)
    x, y = (order_minhash.word_bits(v).view(np.uint64) for v in (a, b))
    assert max(np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()) <= edits
    assert order_minhash.fewest_edits(order_minhash.word_counts(a)[None], order_minhash.word_counts(b)[None])[0] <= edits


def test_banded_alignment_of_long_texts():
    rng = random.Random(1)
    for edits in (0, 3, 40, 90):
        a = [rng.randrange(500) for _ in range(400)]
        b = list(a)
        for _ in range(edits):
            at = rng.randrange(len(b))
            b[at:at + 1] = rng.choice([[], [7, 8], [9]])
        want = plain_edits(a, b)
        got = order_minhash.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), 80)
        assert got == (want if want <= 80 else None)


def test_sketch_keeps_text_order():
    """Sketches of the same shingles in another order differ; equal texts agree."""
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(2))
    one, two, same = order_minhash.sketch([np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([a, b])])
    assert (one == same).all() and 0 < (one == two).sum() < order_minhash.SKETCHES


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 8), (8, 9), (9, 10), (10, 11), (11, 7), (3, 3)] + [(100, k) for k in range(101, 150)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in (1, 2, 3)} == {1} and got[4] == got[5] == 4 and {got[k] for k in range(7, 12)} == {7}
    assert {got[k] for k in range(100, 150)} == {100}


def near_classes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts, want = [], []
    for group in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 3, 6])):
            copy = list(base)
            for _ in range(len(copy) // 60):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
            want.append(group)
        # the passage many share does not make its documents near
        texts.append(shared + " " + " ".join(rng.choice(vocabulary) for _ in range(60)))
        want.append(("own", group))
    got = near_classes(spark, texts)
    first = {}
    for i, g in enumerate(want):
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in enumerate(want)}


@pytest.mark.parametrize("similarity, least", [(0.8, 0.9), (0.9, 0.99)])
def test_spread_edits_are_found_beside_others(spark, similarity, least):
    """Pairs with evenly spread substitutions, each beside a text that shares half of the first."""
    rng = random.Random(4)
    fresh = (f"w{i}" for i in itertools.count())
    texts, n, size = [], 100, 400
    for _ in range(n):
        a = [next(fresh) for _ in range(size)]
        b = list(a)
        for k in range(round((1 - similarity) * size)):
            b[int(k / (1 - similarity))] = next(fresh)
        half = a[:size // 2] + [next(fresh) for _ in range(size // 2)]
        texts += [" ".join(x) for x in rng.sample([a, half], 2)] + [" ".join(b)]
    got = near_classes(spark, texts)
    sizes = Counter(got.values())
    assert set(sizes.values()) <= {1, 2}
    assert sum(v == 2 for v in sizes.values()) >= least * n


def test_rounds_of_labels_end_when_they_settle_little(spark, monkeypatch):
    """No leading pair is near here, and a round of labels settles one of 20 pairs: there is no
    second one, and the last step finds the others."""
    texts = [[f"own{i}x{k}" for k in range(60)] for i in range(20)]
    texts += [t[:30] + ["changed"] + t[31:] for t in texts]
    calls, real, old = [], order_minhash.verify, order_minhash._crossing_pairs

    def verify(pairs, *a):
        calls.append("pairs")
        found = real(pairs, *a)
        return found if "crossing" in calls else found.limit(len(calls) - 1 and 1)

    monkeypatch.setattr(order_minhash, "verify", verify)
    monkeypatch.setattr(order_minhash, "_crossing_pairs", lambda *a: calls.append("crossing") or old(*a))
    assert near_classes(spark, [" ".join(t) for t in texts]) == {i: i % 20 for i in range(40)}
    assert calls == ["pairs", "pairs", "crossing", "pairs"]


def test_only_texts_of_pairs_travel(spark):
    texts = spark.createDataFrame([(i, b"a b") for i in range(50)], "node long, words binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    joined = order_minhash._with_texts(pairs, texts)
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    assert sorted((r.a, r.b) for r in joined.collect()) == [(1, 2), (1, 3)]


def test_equal_texts_of_a_task_leave_its_first_function_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["A b", "a, b", "c", None, ""])], names=["text"])
    got = pa.Table.from_batches(order_minhash._worded(iter([batch, batch])))
    assert got.column("words").to_pylist() == [b"a b", b"c", b""]


def test_near_dedup_on_given_documents(spark, given_docs):
    """No pair of shingle similarity 0.8 or more is split between classes."""
    got = {r.doc_id: r for r in queries.op2_order_minhash(spark, SF).collect()}
    shingles = {}
    for k, t in given_docs.items():
        w = order_minhash.words_of(t.encode())
        shingles[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    keys = sorted(shingles)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(shingles[a] & shingles[b]) >= 0.8 * max(1, len(shingles[a] | shingles[b])):
                assert got[a].class_id == got[b].class_id
    sizes = Counter(r.class_id for r in got.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_near_dedup_of_awkward_rows(spark):
    got = order_minhash.classes(documents(spark)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == by[3] == by[4] == {1} and by[10] == {10} and by[11] == {11} and by[5] == by[6] == {5}
    assert len(got) == len(rows()) and sum(r.kept for r in got) == len({(r.class_id, r.digest if r.class_id == 7 else 0) for r in got})
    kept = order_minhash.drop_near_copies(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert order_minhash.classes(empty(spark)).count() == 0 and order_minhash.drop_near_copies(empty(spark)).count() == 0


# 3 byte-level BPE

def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def codec():
    return rank_queue_bpe._codec(open(queries.RANKS, "rb").read(), public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("aeinst \n'", max_size=200))
def test_bpe_matches_the_library(text):
    ids = np.frombuffer(codec().encode(text), "<u4").tolist()
    assert ids == library_().encode_ordinary(text)
    assert codec().decode(np.array(ids, "<u4").tobytes()) == text.encode()


_lib = []


def library_():
    if not _lib:
        _lib.append(library())
    return _lib[0]


def test_bpe_of_long_pre_tokens():
    rng = random.Random(2)
    for t in ("a" * 30_000, "".join(rng.choice("etaoinshrd") for _ in range(30_000)), "=" * 5000, "é" * 5000):
        assert np.frombuffer(codec().encode(t), "<u4").tolist() == library_().encode_ordinary(t)


def test_rank_queue_on_any_ranks():
    """Also where a merge brings up a pair that goes before all others."""
    rng = random.Random(0)
    for _ in range(300):
        ranks = rng.sample(range(6, 3000), 25)
        pairs = {rng.choice([*range(6), *ranks]) << 20 | rng.choice([*range(6), *ranks]): r for r in ranks}
        ids = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        queued = [pairs.get(a << 20 | b, -1) for a, b in zip(ids, ids[1:])] + [-1]
        got = rank_queue_bpe.merge_by_rank(list(ids), queued, pairs.get)
        while True:
            ready = [(pairs[k], i) for i, k in enumerate(a << 20 | b for a, b in zip(ids, ids[1:])) if k in pairs]
            if not ready:
                break
            rank, i = min(ready)
            ids[i:i + 2] = [rank]
        assert got == ids


def test_bpe_rows(spark, given_docs):
    for r in queries.op3_rank_queue_bpe(spark, SF).collect():
        ids = np.array(library_().encode_ordinary(given_docs[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(given_docs[r.doc_id].encode()).hexdigest()
    got = rank_queue_bpe.encode(documents(spark), queries.RANKS, public_tokenizers.PATTERN)
    back = rank_queue_bpe.decode(got, queries.RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, *_ in rows())
    assert rank_queue_bpe.encode(empty(spark), queries.RANKS, public_tokenizers.PATTERN).count() == 0


# 4 urls

def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_one_url_goes_to_many_ranges(spark):
    """A third of the rows with one url and a third with none are cut like the others."""
    data = [(i, [None, "http://hot.example.org/en/1", f"http://h{i}.com/de/"][i % 3]) for i in range(3000)]
    df = spark.createDataFrame(data, "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = url_rules.judge(df, rules, ranges=12)
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1000 and sum(sizes) == 3000
    found = Counter((r.rule, r.verdict) for r in got.collect())
    assert found == {(None, "allow"): 1000, ("example.org/en/1", "block"): 1000, ("com/de/", "block"): 1000}


def test_url_rules(spark):
    rng = random.Random(4)
    labels = ["a", "b", "com", "org", "example", "", "xn--é", "a-b", "a/b"[:1]]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rules = [(h, rng.choice(["", "/", "/en/", "/en/1", "/x"]), rng.choice(["allow", "block"])) for h in hosts[:30]] + queries.URL_RULES
    urls = [None, "", "no scheme", "://", "http://", "http://ORG/x", "http://é.Org?q=/", "http://org:80/", "x://org#/a", "http://org/a\nb?c"]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/1?x', '/en/2#y', '/x/y', '?z', '/de/'])}" for _ in range(400)]
    urls += ["http://hot.example.org/es/p"] * 300
    df = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    given_rules = spark.createDataFrame(rules + [rules[0], (None, "/", "block")], "host string, path string, verdict string")
    for ranges in (1, 7):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, given_rules, ranges=ranges).collect()}
        assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
    assert url_rules.judge(df.where("false"), given_rules).count() == 0
    none = url_rules.judge(df, given_rules.where("false"), default="block")
    assert none.where("verdict = 'block' and rule is null").count() == len(urls)


# 5 exact dedup

def test_misra_gries_keeps_the_frequent():
    rng = random.Random(5)
    stream = [f"k{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(5000)] + ["hot"] * 1500
    rng.shuffle(stream)
    kept = Counter()
    for at in range(0, len(stream), 500):
        kept = heavy_dedup.merge_counts(kept, Counter(stream[at:at + 500]), 20)
    true = Counter(stream)
    assert len(kept) <= 20
    for k, n in true.items():
        assert kept[k] <= n and kept[k] >= n - len(stream) / 21


@pytest.mark.parametrize("capacity", [1, 3, 1023])
def test_exact_groups(spark, capacity):
    docs = documents(spark)
    got = heavy_dedup.groups(docs, capacity=capacity).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    want = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, top, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(want)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    left = heavy_dedup.drop_copies(docs, capacity=capacity)
    assert left.columns == docs.columns
    assert ordered((r.doc_id,) for r in left.collect()) == ordered((r.doc_id,) for r in got if r.kept)
    assert heavy_dedup.groups(empty(spark)).count() == 0 and heavy_dedup.drop_copies(empty(spark)).count() == 0


# 6 quality

def test_passages_and_gradient():
    texts = [b"", b"abc" * 1000, b"x", b"y" * 1024]
    x, counts = attention_quality.encode_passages(texts)
    assert counts.tolist() == [1, 3, 1, 1] and len(x) == 6 and not x[0].any()
    alone, _ = attention_quality.encode_passages([texts[1]])
    assert np.allclose(x[1:4], alone)


def test_attention_finds_the_telling_passage():
    """Bags that differ in one passage only: learned from bag labels alone."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 8, 600)
    labels = rng.integers(0, 2, 600).astype(np.float32)
    x = rng.random((int(counts.sum()), 20)).astype(np.float32)
    x[:, 0] = 0
    first = np.cumsum(counts) - counts
    told = first + rng.integers(0, counts)
    x[told[labels == 1], 0] = 2
    model = attention_quality.train(x, counts, labels, attention_quality.Plan(epochs=40))
    score = model.score(x, counts)
    assert ((score > 0.5) == (labels == 1)).mean() > 0.95
    many = (labels == 1) & (counts > 3)
    weight = model.forward(x, counts)["a"][told[many]]
    assert weight.mean() > 1.5 * (1 / counts[many]).mean()


def test_gradient_of_the_bag_model():
    """The step of the fit is the slope of the log loss, taken numerically over all layers."""
    rng = np.random.default_rng(1)
    counts, labels = np.array([3, 1, 4]), np.array([1, 0, 1], np.float32)
    x = rng.standard_normal((8, attention_quality.WIDTH)).astype(np.float32)
    start = attention_quality.train(x, counts, labels, attention_quality.Plan(epochs=0, hidden=3, attention=2))
    after = attention_quality.train(x, counts, labels, attention_quality.Plan(epochs=1, hidden=3, attention=2, decay=0.0))

    def loss(layers):
        s = attention_quality.Model({k: v.astype(np.float64) for k, v in layers.items()}).forward(x.astype(np.float64), counts)["s"]
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    for name, layer in start.layers.items():
        for at in list(np.ndindex(layer.shape))[:12]:
            slopes = []
            for step in (1e-5, -1e-5):
                moved = {k: v.astype(np.float64) for k, v in start.layers.items()}
                moved[name][at] += step
                slopes.append(loss(moved))
            slope = (slopes[0] - slopes[1]) / 2e-5
            if abs(slope) > 1e-4:  # the first step of Adam goes against the sign of the slope
                assert np.sign(after.layers[name][at] - layer[at]) == -np.sign(slope), (name, at)


def test_the_sample_is_bounded_in_passages(spark):
    docs = spark.createDataFrame([(i, "word " * (40_000 if i % 2 else 20)) for i in range(1, 41)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, quality int")
    seen = []
    real, attention_quality.train = attention_quality.train, lambda x, counts, *rest: (seen.append(counts), real(x, counts, *rest))[1]
    try:
        model = attention_quality.fit(docs, labels)
    finally:
        attention_quality.train = real
    assert max(seen[0]) == attention_quality.Plan().sample_passages and len(seen[0]) <= 40
    assert attention_quality.score(docs, model).count() == 80


def test_quality_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op6_attention_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    met = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in met) / len(met) > 0.85
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (9, None), (7, 0), (7, 1), (12, 0)], "doc_id long, quality int")
    model = attention_quality.fit(docs, labels)
    assert attention_quality.score(docs, model).count() == len(rows())
    assert attention_quality.keep_good(docs, model).columns == docs.columns
    none = attention_quality.fit(docs, labels.where("false"))
    assert {r.score for r in attention_quality.score(docs, none).collect()} == {0.5}
    assert attention_quality.score(empty(spark), model).count() == 0


# 7 token counts

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path, cache = public_tokenizers.path(name), shared_path(spark, "cache")
    docs = documents(spark).union(documents(spark).where("doc_id = 1").withColumn("text", F.lit("tail <|endoftext|> of it")))
    count = token_counts.counter_of(open(path, "rb").read(), name.rsplit(".", 1)[1])
    want = Counter((r.doc_id, len((r.text or "").encode()), n, n > 5) for r in docs.collect() for n in count([r.text or ""]))
    for _ in range(2):
        got = token_counts.counts(docs, path, cache, limit=5).collect()
        assert Counter(tuple(r) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r.text or "" for r in docs.collect()})


def test_rows_of_a_frequent_content_do_not_meet(spark, tmp_path):
    """A third of the rows are one text: they never enter the join by digest."""
    docs = spark.createDataFrame([(i, "hot words" if i % 3 == 0 else f"text {i}") for i in range(300)], "doc_id long, text string")
    got = token_counts.counts(docs.repartition(4), queries.VOCABULARY, str(tmp_path / "cache"))
    assert {r.doc_id for r in got.collect()} == set(range(300)) and got.count() == 300
    assert len({r.n_tokens for r in got.collect() if r.doc_id % 3 == 0}) == 1 and got.where("n_tokens is null").isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2


def test_cache_grows_by_misses_only(spark):
    cache = shared_path(spark, "cache")
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    token_counts.fill(docs.where("doc_id = 1"), queries.VOCABULARY, cache)
    version = token_counts.fill(docs, queries.VOCABULARY, cache)
    assert spark.read.parquet(cache).count() == 2
    token_counts.fill(docs, public_tokenizers.path("word_bpe_49k.json"), cache)
    assert spark.read.parquet(cache).count() == 4 and token_counts.read_cache(spark, cache, version).count() == 2
    assert token_counts.counts(docs.where("false"), queries.VOCABULARY, cache).count() == 0


# 8 secrets

def plain_base(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return ([("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
            + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
            + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Api_Key", "apikey", "token", "ſecret", "toKen", "=", ": ", '"', "'", "AKIA", "ABCDEF0123",
                                 "deadbeef" * 3, "0123abcd" * 2, "x", " ", "secret=", "zz9", "é"]), max_size=14).map("".join))
def test_base_spans(t):
    assert sorted(secret_scan.base_spans(t, t.encode().lower())) == sorted(plain_base(t))


def test_guess_cost():
    ranks = {w: i + 1 for i, w in enumerate(secret_scan.WORDS)}

    def cost(v):
        return secret_scan.guess_cost(v, ranks)

    assert cost("password") < cost("P4ssw0rd") < cost("xkqvzjwp")
    assert cost("qwertyuiop") < 5 and cost("aaaaaaaaaaaa") < 5 and cost("abcabcabcabc") < 7
    assert cost("1999-12-31") < 6 and cost("dragon2015") < 8 < cost("d9Gx27Qp1Z")
    assert cost("welcomemonkey") < cost("welcomemoqzey")
    assert cost("Zx81kq" * 2000) < 20  # a block said again has one price, however often and wherever
    long = "".join(random.Random(5).choices("bdfhjlnprtvxz2468", k=3000))
    assert cost(long) > 1000  # long values are priced whole


def test_long_values_are_priced_as_one():
    ranks = {w: i + 1 for i, w in enumerate(secret_scan.WORDS)}

    def cost(v):
        return secret_scan.guess_cost(v, ranks)

    assert abs(cost("-" * 200) - math.log10(33 * 200) - math.log10(2)) < 0.01
    assert cost("qwertyuiop" * 20) < 30 and cost("x" * 60 + "password") < cost("x" * 60) + cost("password") + 0.01
    assert abs(cost("k" * 61 + "welcome") - cost("k" * 61) - cost("welcome")) < 0.01  # a word across the 64th character


VALUES = st.lists(st.sampled_from(["a", "b", "1", "q", "w", "e", "pass", "Word", "p@s", "2019", "-12", "ab", "é", "aaa", "é1b"]),
                  min_size=1, max_size=7).map("".join).map(lambda v: v[:14])
SOME = {"pass": 1, "password": 2, "ana": 3, "éab": 4, "wab": 5}


def plain_cost(value):
    """The least sum over every segmentation, each segment priced by its own rule."""
    low = "".join(c.lower() for c in value)
    plain, two = low.translate(secret_scan.LOOK_ALIKE), math.log10(2)

    def price(j, i):
        n, part = i - j, value[j:i]
        found = [0.1 + math.log10(secret_scan._alphabet(part))] if n == 1 else []
        if n >= 3:
            if low[j:i] in SOME:
                found.append(math.log10(SOME[low[j:i]] + 1) + (part != low[j:i]) + two)
            if plain[j:i] in SOME:
                found.append(math.log10(SOME[plain[j:i]] + 1) + 1.3 + two)
            if all(low[k:k + 2] in secret_scan.NEIGHBOURS for k in range(j, i - 1)):
                found.append(math.log10(188 * n) + two)
            if len(set(part)) == 1:
                found.append(math.log10(secret_scan._alphabet(part[0]) * n) + two)
        if secret_scan.DATE.fullmatch(part):
            found.append(math.log10(365 * 120 if n >= 6 else 12 * 120 if n > 4 else 120) + two)
        found += [math.log10((p + 1) * n) + two for p in range(1, min(j, n) + 1) if value[j:i] == value[j - p:i - p]]
        return min(found, default=math.inf)

    def least(i):
        return 0.0 if i == 0 else min(done[j] + price(j, i) for j in range(i))

    done = []
    for i in range(len(value) + 1):
        done.append(least(i))
    return done[-1]


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_cost_is_the_least_of_all_segmentations(value):
    assert abs(secret_scan.guess_cost(value, SOME) - plain_cost(value)) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ab", "a", "aba", "c", "abcabc", "bb"]), max_size=12).map("".join))
def test_runs_are_all_maximal_repetitions(value):
    def period(part):
        return next(p for p in range(1, len(part) + 1) if part[p:] == part[:len(part) - p])

    n = len(value)
    want = set()
    for s in range(n):
        for e in range(s + 2, n + 1):
            p = period(value[s:e])
            if e - s >= 2 * p and (s == 0 or value[s - 1] != value[s - 1 + p]) and (e == n or value[e] != value[e - p]):
                want.add((s, e, p))
    assert set(secret_scan.periodic_runs(value)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["password", "qwertyuiop", "x", "7", "K", "-" * 20, "ab" * 15, "2019-12-31", "zq"]), min_size=1, max_size=40).map("".join),
       st.sampled_from([3.0, 9.0, 25.0]))
def test_growing_prefixes_decide_as_the_whole(value, threshold):
    words = secret_scan.Lexicon(SOME)
    assert secret_scan.is_costly(value, words, threshold) == (secret_scan.guess_cost(value, words) >= threshold)


def test_values_of_any_script_and_place():
    ranks = {w: i + 1 for i, w in enumerate([*secret_scan.WORDS, "donaudampfschiffahrtsgesellschaft"])}

    def values(t):
        return [t[a:b] for _, a, b in secret_scan.guess_spans(t, t.encode().lower(), ranks, secret_scan.Prices())]

    assert values('pwd: "Zürich-9xK!pQ2#v"') == ["Zürich-9xK!pQ2#v"] and values("password = пароль-9xK!pQ2") == ["пароль-9xK!pQ2"]
    assert values('pwd="h7#Kq!zP2wé4"') == ["h7#Kq!zP2wé4"]
    assert values("mypwd=h7#Kq!zP2w") == ["h7#Kq!zP2w"] and values("dbpassword: h7#Kq!zP2w;") == ["h7#Kq!zP2w"]
    assert values("spin: h7#Kq!zP2w") == [] and values("pwd=h7#Kq!zP2w\u3000x") == ["h7#Kq!zP2w"]
    assert secret_scan.guess_cost("donaudampfschiffahrtsgesellschaft", ranks) < 3
    block, before = "kR7#mQz9!xW2$vT4^nB6&hJ8d", "".join(random.Random(3).choices("bdfhjlnprtvxz2468", k=80))
    more = lambda head: secret_scan.guess_cost(head + 2 * block, ranks) - secret_scan.guess_cost(head + block, ranks)
    assert abs(more("") - more(before)) < 0.01 and more("") < 4


def test_every_key_has_its_value():
    ranks = {w: i + 1 for i, w in enumerate(secret_scan.WORDS)}

    def values(t):
        return [t[a:b] for _, a, b in secret_scan.guess_spans(t, t.encode().lower(), ranks, secret_scan.Prices())]

    secret = "h7#Kq!zP2w"
    for t in ('{"login":"admin","pwd":"%s"}', "login=admin&pwd=%s", "login=admin;pwd=%s;host=localhost", "{login:admin},{pwd:%s}",
              "LOGIN='admin',PWD='%s'", '{"url":"https://h.test/?login=admin&pwd=%s","n":1}', "pwd=%s,login=password",
              '{"login":"","pwd":"%s","pin":"123456"}', "pwd=%s\nlogin=admin", '{"pwd": "%s", "login": "monkey"}'):
        assert values(t % secret) == [secret], t
    assert values("password:" + "-" * 200) == [] and values('{"login":"hello","secret":"sunshine","pwd":"monkey"}') == []
    assert values("pwd=>Tr0ub4dor&3xQz!") == ["Tr0ub4dor&3xQz!"] and values('pwd="a,b;c&d}Zx9!"') == ["a,b;c&d}Zx9!"]
    many = '"pwd":"%s",' % secret
    assert values(many * 3000) == [secret] * 3000


def test_secret_rows(spark, given_docs):
    for r in queries.op8_secret_scan(spark, SF).collect():
        base = secret_scan.written_spans(plain_base(given_docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert not base or set(base.split(",")) <= set(r.spans.split(","))
    texts = ["login: g7Qk2xWz9pLm", "password = password123", "pin: the value", "pwd=>Tr0ub4dor&3xQz!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.scan(df).collect()}
    assert spans[0] == "guess:7:19" and "guess" not in spans[1] and spans[2] == "" and spans[3].startswith("guess:5:")
    assert secret_scan.scan(documents(spark)).count() == len(rows()) and secret_scan.scan(empty(spark)).count() == 0
    assert secret_scan.frequent_words(documents(spark), 3)


# 9 decontamination

def plain_hits(text, items, size=13, share=20):
    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]

    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        cut = min(size, len(v))
        wins = {tuple(v[i:i + cut]) for i in range(len(v) - cut + 1)} if v else set()
        for s in range(len(w) - cut + 1):
            if tuple(w[s:s + cut]) in wins:
                hit |= set(range(s, s + cut))
                found.add(str(item))
    names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), names, len(hit) > 0 and share * len(hit) >= len(w)


@pytest.mark.parametrize("small", [True, False])
def test_windows(spark, monkeypatch, small):
    monkeypatch.setattr(window_match, "fits", lambda df: small)
    rng = random.Random(6)
    items = [(1, BODY), (2, BODY[:60]), (3, "one"), (4, "two words"), (5, "a b a b a b a b a b a b a b a b a b"), (6, None), (7, "..."),
             (8, " ".join(rng.choice("abc") for _ in range(40))), (8, "repeated id with other words in it")]
    texts = [t for _, t, *_ in rows()] + ["a b " * 20, "x y " + BODY[100:250] + " z", "one", "Two, WORDS", "two  words one two",
                                         " ".join(rng.choice("abc") for _ in range(3000)), "b a " * 9]
    ids = [r[0] for r in rows()] + list(range(100, 107))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("words", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    got = Counter(tuple(r) for r in window_match.judge(df, bench).collect())
    assert got == Counter((i, *plain_hits(t, items)) for i, t in zip(ids, texts))
    none = window_match.judge(df, bench.where("false"))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(texts)
    assert window_match.judge(df.where("false"), bench).count() == 0


def test_windows_stay_in_the_jvm(spark):
    plan = queries.op9_window_match(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 10 language model

def test_seating_follows_the_restaurant():
    """Mean tables of exact one-by-one seating, by simulation."""
    rng = np.random.default_rng(7)
    n, a, d = 300, 2.5, 0.4
    got = pitman_yor.seat(np.full(4000, n), np.full(4000, a), d, rng)
    plain = []
    for _ in range(1500):
        k = 1
        for i in range(1, n):
            k += rng.random() < a / (i - d * k + a)
        plain.append(k)
    assert abs(got.mean() - np.mean(plain)) < 0.6
    assert (pitman_yor.seat(np.ones(5, np.int64), np.full(5, 9.0), d, rng) == 1).all()


def learned(spark, texts, **more):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return docs, pitman_yor.fit(docs, pitman_yor.Plan(**more))


def test_model_is_a_distribution(spark):
    """The words a text can start with, the end and one unknown word add up to one;
    and a word scores the same settled map-side or joined. The extra token's price
    cancels: p(w, end) / p(end after w), read off the text that repeats w's context."""
    texts = ["a b c a b d", "b b a é", "c", "", "a  B\tc a"]
    _, model = learned(spark, texts)
    words = [*sorted({w for t in texts for w in t.lower().split()}), "zzz"]
    asked = ["", *words, *[f"{u} {w}" for u in words for w in words]]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    found = []
    for frequent in (1, 3, 100):
        got = {asked[r.doc_id]: r.score for r in pitman_yor.score(df, model, frequent=frequent).collect()}
        found.append(got)
        # P(w w) / P(w) = P(w | w); all v after u: sum of P(u v) / P(u) * P(end | u) / P(end | v), P(end | v) from the sums below.
        end = {}
        for u in words:
            rest = {v: 10 ** (got[f"{u} {v}"] - got[u]) for v in words}  # P(v|u) P(end|v) / P(end|u)
            end[u] = rest
        # Solve for e_u = P(end|u): 1 - e_u = sum_v P(v|u) = sum_v rest[u][v] * e_u / e_v.
        e = {u: 0.1 for u in words}
        for _ in range(3000):
            e = {u: 1 / (1 + sum(end[u][v] / e[v] for v in words)) for u in words}
        total = 10 ** got[""] + sum(10 ** got[w] / e[w] for w in words)
        assert total == pytest.approx(1, abs=1e-6)
    assert found[0] == pytest.approx(found[1]) and found[1] == pytest.approx(found[2])


def test_the_whole_word_before_is_the_context(spark):
    """``cat`` and ``bat`` end alike, but other words follow them: learned, the one that
    does is likelier by far."""
    _, model = learned(spark, ["cat sleeps cat sleeps cat sleeps", "bat flies bat flies bat flies"] * 5)
    asked = ["cat sleeps", "cat flies", "bat sleeps", "bat flies"]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {asked[r.doc_id]: r.score for r in pitman_yor.score(df, model).collect()}
    assert got["cat sleeps"] > got["cat flies"] + 1 and got["bat flies"] > got["bat sleeps"] + 1
    assert pitman_yor.tokens_of(b"A cat") == ([b"a", b"cat", b""], [b"", b"a", b"cat"])


def test_scores_against_the_base(spark, given_docs):
    got = queries.op10_pitman_yor(spark, SF).collect()
    counts = Counter()
    for k, t in given_docs.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(pitman_yor.tokens_of(t.encode())[0])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        words, _ = pitman_yor.tokens_of(given_docs[r.doc_id].encode())
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_without_a_number_score_alike(spark, monkeypatch):
    """However few words have numbers, and in however many waves tokens meet their pairs."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["long" * 30]
    texts = [" ".join(vocabulary[int(300.99 * rng.random() ** 3)] for _ in range(rng.randrange(60))) for _ in range(150)]
    found = []
    for words, waves in ((1 << 18, 1), (40, 3)):
        monkeypatch.setattr(pitman_yor, "WORDS", words)
        monkeypatch.setattr(pitman_yor, "WAVES", waves)
        monkeypatch.setattr(pitman_yor, "WAVE_TOKENS", 10)
        docs, model = learned(spark, texts)
        got = pitman_yor.score(docs, model, frequent=20).orderBy("doc_id").collect()
        assert len(model.names.number.value) <= words
        found.append(got)
    for got in found[1:]:
        assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(r.n_tokens, r.n_known, r.train_tokens) for r in found[0]]
        assert [r.base_score for r in got] == pytest.approx([r.base_score for r in found[0]])
        assert sum(r.score for r in got) == pytest.approx(sum(r.score for r in found[0]), rel=0.01)


def test_model_of_awkward_rows(spark):
    docs = documents(spark)
    model = pitman_yor.fit(docs)
    assert pitman_yor.score(docs, model).where("score <= 0 and n_known = n_tokens").count() == len(rows())
    assert pitman_yor.score(empty(spark), model).count() == 0
    none = pitman_yor.score(docs, pitman_yor.fit(empty(spark)))
    assert none.where("score = 0 and base_score = 0 and n_known = 0").count() == len(rows())
