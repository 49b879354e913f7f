"""Shared ids, ingestion end to end, streaming."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from turnstone.operators import dedup, embed, hybrid, maintain, postings
from turnstone.plans import ingest
from turnstone.settings import Settings
from turnstone.sources.store import EPISODES, Conflict, Store
from turnstone.streaming import ingest_stream, spans

COLUMNS = "source_path string, guest string, title string, video_id string, body string"


def decisions(spark, rows, same=None):
    df = spark.createDataFrame([(f"/c/{p}/transcript.md", *r) for p, *r in rows], COLUMNS)
    return {r.source_path.split("/")[2]: r.decision for r in dedup.decide(df, same=same).collect()}


TALK = "we spoke about pricing and packaging for a long time and it was useful " * 20
OTHER = "hiring managers read the roadmap before quarterly planning starts again " * 20


def test_decisions(spark):
    assert decisions(spark, [("a", "Ana Bell", "Ana Bell on pricing", "v1", TALK),
                             ("b", "Rex Moor", "Ana Bell on pricing", "v1", OTHER)]) == {"a": "keep", "b": "borrowed"}
    assert decisions(spark, [("a", "Rex Moor", "Ana Bell on pricing", "v1", OTHER),
                             ("b", "Ana Bell", "Ana Bell on pricing", "v1", TALK)]) == {"a": "borrowed", "b": "keep"}
    assert decisions(spark, [("a", "Ana Bell", "t", "v1", TALK),
                             ("b", "Ana Bell", "t", "v1", TALK + "tail")]) == {"a": "keep", "b": "duplicate"}
    assert decisions(spark, [("a", "Ana Bell", "Ana Bell 2.0 returns", "v1", TALK),
                             ("b", "Ana Bell 2.0", "x", "v1", OTHER)]) == {"a": "borrowed", "b": "borrowed"}
    assert decisions(spark, [("a", "A", "t", "v1", TALK), ("b", "B", "t", "v2", TALK)]) == {"a": "keep", "b": "keep"}


def test_no_side_of_a_join_passes_the_driver(spark, monkeypatch):
    """However few bytes a table packs into: neither what is written on the way nor the
    result broadcasts."""
    plans, write = [], dedup.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(dedup, "stored", watched)
    monkeypatch.setattr(dedup, "AT_ONCE_ROWS", 4)
    rows = [(f"/c/p{i:02d}/transcript.md", "Ana Bell", "Ana Bell", "hot" if i % 3 else f"v{i % 2}", f"{TALK} {i % 7} " * (i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, COLUMNS)
    decided = dedup.drop_borrowed(dedup.decide(df.withColumn("content_hash", F.sha2("body", 256)), same=dedup.ByShingles(0.5)))
    judged = ingest.outcomes(decided, decided.select("video_id", "content_hash"))
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (decided, judged)]
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("at_once", [1_000, 0])
def test_both_ways_match_the_greedy_rule(spark, monkeypatch, at_once):
    monkeypatch.setattr(dedup, "AT_ONCE_ROWS", at_once)
    monkeypatch.setattr(dedup, "PER_ROUND", (8,))
    monkeypatch.setattr(dedup, "PART_ROWS", 3)
    rng = random.Random(11)
    seeds = ["".join(rng.choice("abcdef ") for _ in range(80)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 2, 5, 9])):
            text[rng.randrange(80)] = rng.choice("xyz")
        rows.append((f"p{i:03d}", "G", "t", "hot" if i % 3 else "warm", "".join(text)))
    got = decisions(spark, rows)
    for vid in ("hot", "warm"):
        kept = []
        for p, *_, v, body in rows:
            if v != vid:
                continue
            copy = any(difflib.SequenceMatcher(None, body, k, autojunk=False).ratio() > 0.9 for k in kept)
            assert (got[p] == "duplicate") == copy, p
            if not copy:
                kept.append(body)


def test_sequence_bounds_lose_no_alike_text():
    """Pairs on both sides of the ratio, against the plain comparison."""
    rng = random.Random(5)
    rule, seen = dedup.BySequence(0.9), set()
    for size in (1, 3, 12, 60, 400):
        for edits in range(0, size // 4 + 2, max(1, size // 40)):
            a = "".join(rng.choice("etaoin shrdlu\u00e9\U0001f600") for _ in range(size))
            b = list(a)
            for _ in range(edits):
                at = rng.randrange(len(b) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    b.insert(at, rng.choice("xyz"))
                elif b and kind == 1:
                    b.pop(at % len(b))
                elif b:
                    b[at % len(b)] = rng.choice("xyz")
            b = "".join(b)
            index = rule.kept()
            for other in ("", "unlike " * 9, b):
                index.add(other)
            want = any(rule.alike(a, k) for k in index.texts)
            assert index.holds(a) == want, (a, b)
            seen.add((size, want))
    assert {w for _, w in seen} == {True, False}
    assert not rule.kept().holds("") and not rule.kept().holds("a")


def test_sequence_rule_equals_the_plain_ratio(monkeypatch):
    """Stretches of any size, ratios on the pair's own, and long texts in little time."""
    rng = random.Random(2)
    for small in (0, 1 << 14):
        monkeypatch.setattr(dedup.LongestBlocks, "SMALL", small)
        for size in (0, 1, 5, 40, 260) * 8:
            a = "".join(rng.choice("ab \u00e9\U0001f600") for _ in range(size))
            b = list(a)
            for _ in range(rng.randrange(size // 4 + 2)):
                at = rng.randrange(len(b) + 1)
                b[at:at + rng.randrange(3)] = rng.choice(["", "x", "ab ", "".join(b[:7])])
            b, blocks = "".join(b), dedup.LongestBlocks(a, "".join(b))
            plain = difflib.SequenceMatcher(None, a, b, autojunk=False)
            assert blocks.find(0, len(a), 0, len(b)) == tuple(plain.find_longest_match()), (a, b)
            for ratio in (0.9, 0.5, plain.ratio(), plain.ratio() - 1e-9):
                assert dedup.BySequence(ratio).alike(a, b) == (plain.ratio() > ratio), (a, b, ratio)
    long = " ".join(rng.choice(["ship", "price", "team", "plan", str(i)]) for i in range(12_000))
    assert dedup.BySequence(0.9).alike(long, long[:30_000] + "new" + long[30_100:])
    assert not dedup.BySequence(0.9).alike(long, long[::-1])


@pytest.mark.parametrize("same", [None, dedup.ByShingles(0.5)])
def test_whole_texts_decide(spark, same):
    """One beginning of over 3,000 characters, then something else; and the other way round."""
    rng = random.Random(4)
    talk = lambda: " ".join("".join(rng.choice("aeioubcdfg") for _ in range(5)) for _ in range(900))
    a, b, c = talk(), talk(), talk()
    rows = [("a", "G", "t", "v", a[:3200] + b), ("b", "G", "t", "v", a[:3200] + c), ("c", "G", "t", "v", c[:400] + b)]
    df = spark.createDataFrame([(f"/c/{p}/transcript.md", *r) for p, *r in rows], COLUMNS)
    found = {r.source_path[3]: r.decision for r in dedup.decide_copies(df, Settings(same_text_ratio=0.7), same).collect()}
    assert found == {"a": "keep", "b": "keep", "c": "duplicate"}


def test_shingle_index_counts_exact_overlap():
    rng = random.Random(8)
    rule = dedup.ByShingles(0.5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(120)]
    index, kept = rule.kept(), []
    for text in texts:
        own = rule.shingles(text)
        want = any(own and len(own & k) >= 0.5 * len(own | k) for k in kept)
        assert index.holds(text) == want, text
        if not want:
            index.add(text)
            kept.append(own)


@pytest.mark.parametrize("at_once", [20, 0])
def test_hot_ids_in_parts_match_the_greedy_rule(spark, monkeypatch, at_once):
    """Families of near copies, a sentence many texts share, one id large enough for parts
    and parts too large for one task; the plan holds as many tables after any number of rounds."""
    monkeypatch.setattr(dedup, "AT_ONCE_ROWS", at_once)
    monkeypatch.setattr(dedup, "PER_ROUND", (2,))
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    seeds = [[rng.choice(words) for _ in range(rng.randrange(1, 24))] for _ in range(14)]
    rows = []
    for i in range(120):
        text = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if i % 4 == 0:
            text += "all of this is under the same license".split()
        rows.append((f"/c/p{i:03d}/t.md", "hot" if i % 5 else "warm", " ".join(text)))
    df = spark.createDataFrame(rows, "source_path string, video_id string, body string")
    rule = dedup.ByShingles(0.5)
    found = dedup.decide_copies(df, same=rule)
    got = {r.source_path: r.decision for r in found.collect()}
    for vid in ("hot", "warm"):
        kept = []
        for path, v, body in rows:
            if v == vid:
                own = rule.shingles(body)
                copy = any(body == b or (own and len(own & k) >= 0.5 * len(own | k)) for b, k in kept)
                assert (got[path] == "duplicate") == copy, path
                if not copy:
                    kept.append((body, own))
    assert len(found.inputFiles()) > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 5, plan


def test_connected_links(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (95, 101), (200, 201)]
    got = {(r.a, r.b) for r in dedup.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(95, 90), (100, 90), (101, 90), (201, 200)}
    assert dedup.connected(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_null_texts_and_ids(spark):
    rows = [("a", "G", "t", "v", None), ("b", "G", "t", "v", ""), ("c", "G", "t", None, TALK), ("d", "G", "t", None, TALK)]
    assert decisions(spark, rows) == {"a": "keep", "b": "duplicate", "c": "keep", "d": "keep"}


def write(root, folder, guest, title, vid, body, name="Ana"):
    d = root / "episodes" / folder
    d.mkdir(parents=True, exist_ok=True)
    (d / "transcript.md").write_text(
        f"---\nguest: {guest}\ntitle: {title}\nvideo_id: {vid}\npublish_date: 2023-01-02\n---\n{name} (0:01):\n{body}\n"
        f"{name} (0:09):\nThis is brought to you by Acme.\n")


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    write(root, "ana", "Ana Bell", "Ana Bell on pricing", "v1", TALK)
    write(root, "ana-copy", "Ana Bell", "Ana Bell on pricing", "v1", TALK + "tail")
    write(root, "rex", "Rex Moor", "Ana Bell on pricing", "v1", OTHER)
    write(root, "casey", "Casey Park", "Casey Park on hiring", "v2", OTHER)
    return root


def test_ingest_twice_edit_prune(spark, corpus, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = ingest.run(spark, str(corpus), store)
    assert (first["status"], first["episodes_seen"], first["episodes_ingested"], first["episodes_skipped"]) == ("ok", 4, 3, 1), first
    assert {r.video_id for r in store.episodes().collect()} == {"v1", "v2", "slug:rex"}
    chunks = store.chunks().collect()
    assert len(chunks) == first["chunks_written"] > 0
    assert all((c.embedding is None) == c.is_sponsor for c in chunks)
    assert all(len(c.embedding) == 384 for c in chunks if c.embedding is not None)
    rex = store.episodes().where("video_id = 'slug:rex'").first()
    assert (rex.title, rex.youtube_url, rex.publish_date, rex.guest) == ("Untitled episode", "", None, "Rex Moor")

    asked = spark.createDataFrame([("q", "pricing packaging")], "query_id string, query string")
    near = lambda index: sorted((r.chunk_id, r.score) for r in postings.search(asked, index).collect())
    fresh = lambda: postings.build(store.chunks(), str(tmp_path / "postings"))
    assert near(store.index()) == near(fresh()) != []
    assert store.graph() is None
    store.write_graph()
    vectors = embed.embed_queries(asked)
    found = hybrid.search(vectors, store.chunks(), store.episodes(), index=store.index(), graph=store.graph()).hits.collect()
    assert sorted(found) == sorted(hybrid.search(vectors, store.chunks(), store.episodes()).hits.collect()) != []

    second = ingest.run(spark, str(corpus), store)
    assert (second["episodes_ingested"], second["episodes_skipped"], second["chunks_written"]) == (0, 4, 0)
    assert store.chunks().count() == len(chunks)

    write(corpus, "casey", "Casey Park", "Casey Park on hiring", "v2", "Short now.")
    third = ingest.run(spark, str(corpus), store)
    assert third["episodes_ingested"] == 1
    now = [c.text for c in store.chunks().join(store.episodes().where("video_id = 'v2'"), "episode_id").collect()]
    assert sorted(now)[0] == "Ana: Short now." and not any(OTHER[:20] in x for x in now)
    here = lambda index: sorted(r.chunk_id for r in postings.search(asked, index).collect())
    assert here(store.index()) == here(fresh()) and store.graph() is None  # of an older version
    forced = ingest.run(spark, str(corpus), store, force=True)
    assert forced["episodes_ingested"] == 3
    assert store.chunks().groupBy("episode_id", "ordinal").count().where("count > 1").isEmpty()

    (corpus / "episodes" / "casey" / "transcript.md").rename(corpus / "casey.md")
    assert [r.video_id for r in ingest.prune(spark, str(corpus), store).collect()] == ["v2"]
    assert ingest.prune(spark, str(corpus), store).isEmpty()
    runs = {r.run_id for r in store.episodes().collect()}
    live = {tuple(r) for r in store.chunks().select("chunk_id", "run_id").collect()}
    assert store.vacuum() and {tuple(r) for r in store.chunks().select("chunk_id", "run_id").collect()} == live
    assert store.vacuum() == [] and {r.run_id for r in store.episodes().collect()} == runs
    assert {r.video_id for r in store.episodes().collect()} == {"v1", "slug:rex"}
    with pytest.raises(ValueError):
        ingest.prune(spark, str(corpus), store, subset=True)
    assert [r.status for r in store.runs().collect()] == ["ok"] * 4


def test_prune_refuses_an_empty_corpus(spark):
    episodes = spark.createDataFrame([("v1",)], "video_id string")
    with pytest.raises(ValueError):
        maintain.prune(episodes, episodes.where("false"))


def test_failed_run_is_logged_and_commits_nothing(spark, corpus, tmp_path):
    store = Store(spark, str(tmp_path / "store"))

    def broken():
        raise RuntimeError("no model here")

    out = ingest.run(spark, str(corpus), store, make_encoder=broken)
    assert out["status"] == "failed" and store.version() == 0 and store.runs().first().status == "failed"


def test_stream_picks_up_new_files_once(spark, corpus, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    go = lambda: ingest_stream.start(spark, str(corpus), store, str(tmp_path / "cp")).awaitTermination()
    go()
    assert store.episodes().count() == 3
    write(corpus, "new", "Jo Li", "Jo Li on data", "v9", "Fresh words here.", "Jo")
    go()
    go()
    assert {r.video_id for r in store.episodes().collect()} == {"v1", "v2", "slug:rex", "v9"}


def test_second_stream_ingests_its_own_files(spark, corpus, tmp_path):
    """Batch numbers start at zero again; the files must not be taken for done."""
    store = Store(spark, str(tmp_path / "store"))
    ingest_stream.start(spark, str(corpus), store, str(tmp_path / "cp")).awaitTermination()
    other = tmp_path / "other"
    write(other, "new", "Jo Li", "Jo Li on data", "v9", "Fresh words here.", "Jo")
    write(other, "thief", "Casey Park", "Casey Park on hiring", "v2", "Not the stored talk at all.")
    ingest_stream.start(spark, str(other), store, str(tmp_path / "cp2")).awaitTermination()
    assert {r.video_id for r in store.episodes().collect()} == {"v1", "v2", "slug:rex", "v9"}
    assert "casey" in store.episodes().where("video_id = 'v2'").first().source_path


def test_one_of_two_competing_commits_wins(spark, corpus, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest.run(spark, str(corpus), store)
    base, rows = store.version(), store.episodes()
    store.commit(rows.where("video_id = 'v1'"), "first", base)
    with pytest.raises(Conflict):
        store.commit(rows.where("video_id = 'v2'"), "second", base)
    assert [r.video_id for r in store.episodes().collect()] == ["v1"] and store.version() == base + 1
    assert store.committed("first") and not store.committed("second")
    ingest._committed(store, "third", lambda now: now)
    assert store.version() == base + 2


def test_limit_takes_the_first_paths(spark, corpus):
    from turnstone.sources import transcripts

    got = transcripts.scan(spark, str(corpus), 2).collect()
    assert sorted(r.source_path.split("/")[-2] for r in got) == ["ana", "ana-copy"] and all(r.raw for r in got)


def test_keywords_of_any_kind_keep_the_file(spark):
    from turnstone.sources import transcripts

    raw = "---\nvideo_id: v\nkeywords:\n  growth: 1\n  hiring: 2\n---\nbody"
    good, bad = transcripts.parse_files(spark.createDataFrame([("/a/t.md", raw)], "source_path string, raw string"))
    assert good.first().keywords == ["growth", "hiring"] and bad.isEmpty()
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_span_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    line = '{"id":"%s","session_id":"%s","request_id":"%s","kind":"tool_call","name":"search","started_at":"2024-01-0%d 00:00:00","duration_ms":5,"ok":1}\n'
    (inbox / "a.json").write_text(line % ("1", "s1", "r1", 2) + line % ("2", "s1", "r2", 1))
    out = str(tmp_path / "spans")
    run = lambda: spans.append(spans.stream(spark, str(inbox)), out, str(tmp_path / "cp")).awaitTermination()
    run()
    (inbox / "b.json").write_text(line % ("3", "s2", "r3", 3))
    run()
    run()
    table = spark.read.parquet(out)
    assert [r.id for r in spans.read(table).collect()] == ["2", "1", "3"]
    assert [r.id for r in spans.read(table, session_id="s1").collect()] == ["2", "1"]
    assert [r.id for r in spans.read(table, "s1", "r1").collect()] == ["1"]
    assert [r.id for r in spans.read(table, limit=1).collect()] == ["2"]


def test_resent_spans_are_stored_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    line = '{"id":%s,"session_id":"s","request_id":"r","kind":"k","name":"%s","started_at":"%s 00:00:00"}\n'
    run = lambda: spans.append(spans.stream(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (inbox / "a.json").write_text(line % ('"1"', "first", "2024-01-09") + line % ('"1"', "first", "2024-01-09") + line % ("null", "x", "2024-01-09") * 2)
    run()
    (inbox / "b.json").write_text(line % ('"1"', "again", "2024-01-09") + line % ('"old"', "late", "2020-01-01"))
    run()
    got = sorted((r.id or "", r.name) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("", "x"), ("", "x"), ("1", "first"), ("old", "late")]


def test_same_path_wins_residual_collision(spark):
    df = spark.createDataFrame([("/a/x/t.md", "v"), ("/b/x/t.md", "v"), ("/c/y/t.md", "w")], "source_path string, video_id string")
    assert {r.source_path[1]: r.collides for r in dedup.first_per_id(df).collect()} == {"a": False, "b": True, "c": False}


def test_settings_reach_the_packer(spark):
    files = spark.createDataFrame([("e", "A (0:01):\n" + "word. " * 100)], "episode_id string, body string")
    few = ingest.build_chunks(files, lambda: __import__("turnstone.operators.embed", fromlist=["x"]).HashedTerms(8),
                              Settings(target_tokens=20, overlap_tokens=0))
    assert few.agg(F.max("token_count")).first()[0] <= 30 and few.count() == 5


def test_commits_are_whole_or_absent(spark, tmp_path):
    """A writer that ends before its commit leaves nothing a reader sees, the second writer of
    a version loses, and one listing knows all runs."""
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([], EPISODES)
    assert store.version() == 0 and not store.committed("one")
    assert store.commit(rows, "one", 0) == 1
    (tmp_path / "store" / "commits" / "_halfway").mkdir()
    (tmp_path / "store" / "commits" / "_halfway" / "two").touch()
    assert store.version() == 1 and store.committed("one") and not store.committed("two") and store.episodes().count() == 0
    with pytest.raises(Conflict):
        store.commit(rows, "three", 0)
    assert store._commits() == {1: "one"} and not store.committed("three")
