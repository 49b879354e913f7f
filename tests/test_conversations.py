"""Citations, predicates, sessions, markup, admission, evaluation."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from turnstone.functions import admission, citing, rubric
from turnstone.operators import (checks, citing_turns, embed, evaluate, html_clean, load_report, maintain, order_stats,
                                 running, sessions)
from turnstone.operators.running import Running


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_cited_numbers(spark):
    got = column(spark, ["a [1]", "[1, 3]", "[2-4]", "[2–4]", "[1][2]", "[2019-2023] and [1-99]", "[text](url)", "[5-3]", None,
                         "[1, 4-5, 2]"], citing.cited_numbers)
    assert got == [[1], [1, 3], [2, 3, 4], [2, 3, 4], [1, 2], [], [], [], [], [1, 2, 4, 5]]


def test_trivial_and_document_requests(spark):
    assert column(spark, ["Hi", "thanks a lot!", "How are you?", "how are you going to measure it?", "ok...", "yes",
                          "what is retention?", "hint at it", "HELP me please"], citing.is_trivial) == [
        True, True, True, False, True, True, False, False, True]
    assert column(spark, ["Make a Checklist", "one pager", "what is it", "an audit please"], citing.asks_for_document) == [
        True, True, False, True]


def test_numbering_and_cited_subset(spark):
    hits = spark.createDataFrame([("t", 1, 1, "a"), ("t", 1, 2, "b"), ("t", 2, 1, "c"), ("t", 2, 2, "a"), ("u", 1, 1, "z")],
                                 "turn_id string, search_no int, rank int, chunk_id string")
    n = {(r.turn_id, r.chunk_id): r.n for r in citing_turns.number_passages(hits).collect()}
    assert n == {("t", "a"): 1, ("t", "b"): 2, ("t", "c"): 3, ("u", "z"): 1}
    out = spark.createDataFrame([("t", "see [3]"), ("t", "and [1, 9]"), ("u", "The talks do not cover this.")],
                                "turn_id string, text string")
    assert {(r.turn_id, r.n, r.chunk_id) for r in citing_turns.cited_passages(hits, out).collect()} == {("t", 1, "a"), ("t", 3, "c")}
    own = spark.createDataFrame([("t", 1, "q")], "turn_id string, n long, chunk_id string")
    assert [r.chunk_id for r in citing_turns.cited_passages(hits, out, own).collect()] == ["q"]


def test_running_blocks_match_one_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.randint(-9, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running.running(df, ["k"], [F.col("i")], F.floor(F.col("i") / 7), [
        Running("s", "sum", F.col("v")), Running("m", "max", F.col("v"), True), Running("c", "count", F.lit(1))]).collect()
    seen = {}
    for k, i, v in rows:
        before = seen.setdefault(k, [])
        want = (sum(before) + v, max(before, default=None), len(before) + 1)
        r = next(r for r in got if r.k == k and r.i == i)
        assert (r.s, r.m, r.c) == want
        before.append(v)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 500])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    values = [rng.choice([1, 5, rng.randint(0, 10_000)]) for _ in range(n)]
    r = evaluate.latency_summary(spark.createDataFrame([(v,) for v in values], "latency_ms int")).first()
    assert (r.n, r.p50, r.p95, r.max) == (n, statistics.median(values), sorted(values)[int(0.95 * n)], max(values))
    rows = spark.createDataFrame([("k", v) for v in values], "k string, v int")
    assert order_stats.order_statistics(rows, ["k"], "v", {"x": F.lit(1)}).first().x == min(values)


def test_order_statistics_of_many_values(spark, monkeypatch):
    """A hot key with heavy ties, cut into blocks; states kept per day and merged; a sketch that is wrong."""
    rng = random.Random(3)
    rows = [("hot" if i % 4 else f"k{i % 7}", i % 5, float("nan") if i % 97 == 0 else None if i % 89 == 0 else
             float(rng.choice([7, rng.randint(0, 900), rng.gauss(0, 400)]))) for i in range(6_000)]
    df = spark.createDataFrame(rows, "k string, day int, v double").cache()
    ranks = {"first": F.lit(1), "mid": order_stats.index_rank(0.5), "late": order_stats.index_rank(0.99), "last": F.col("total")}
    want = {}
    for k in {r[0] for r in rows}:
        vs = sorted(v for kk, _, v in rows if kk == k and v is not None and v == v)
        want[k] = (len(vs), vs[0], vs[int(0.5 * len(vs))], vs[int(0.99 * len(vs))], vs[-1])
    days = order_stats.sketches(df, ["k", "day"], "v")
    kept = days.groupBy("k").agg(F.sum("total").alias("total"), order_stats.merged("sketch").alias("sketch"))
    wrong = kept.join(order_stats.sketches(spark.createDataFrame([(9e9,)] * 50, "v double"), [], "v").select(
        F.col("sketch").alias("other"))).select("k", "total", F.col("other").alias("sketch"))
    for block, states in ((65_536, None), (20, kept), (65_536, wrong)):
        monkeypatch.setattr(order_stats, "BLOCK", block)
        got = order_stats.order_statistics(df, ["k"], "v", ranks, states)
        assert {r.k: tuple(r)[1:] for r in got.collect()} == want
    assert order_stats.order_statistics(df.where("false"), ["k"], "v", ranks).count() == 0


def test_sessions(spark):
    s = spark.createDataFrame([("a", "A", 1, 5), ("b", "B", 2, 9), ("c", "C", 3, 3)], "session_id string, title string, created_at int, updated_at int")
    m = spark.createDataFrame([("a", f"m{i}", "user" if i % 2 == 0 else "assistant", f"t{i}", i) for i in range(6)]
                              + [("b", "n0", "tool", "x", 0), ("b", "n1", "user", "  Long\ntitle " + "y" * 80, 1)],
                              "session_id string, message_id string, role string, content string, created_at int")
    page = sessions.session_list(s, m, 2, 0).collect()
    assert [(r.session_id, r.message_count) for r in page] == [("b", 2), ("a", 6)]
    assert sessions.history_window(m, 0).count() == 0
    assert {r.content for r in sessions.history_window(m, 2).where("session_id='a'").collect()} == {"t4", "t5"}
    titles = {r.session_id: r.title for r in sessions.session_titles(m).collect()}
    assert titles == {"a": "t0", "b": ("Long title " + "y" * 80)[:60] + "..."}
    detail = sessions.session_detail(s, m).where("session_id = 'a'").orderBy("position").collect()
    assert [(r.position, r.content, r.message_count) for r in detail] == [(i + 1, f"t{i}", 6) for i in range(6)]
    assert sessions.session_detail(s, m).where("session_id = 'c'").first().message_count == 0
    new = spark.createDataFrame([("a", "now"), ("c", "first")], "session_id string, message string")
    p = {r.session_id: [(x.role, x.content) for x in r.prompt] for r in sessions.prompts(new, m, "sys", 2).collect()}
    assert p == {"a": [("system", "sys"), ("user", "t4"), ("assistant", "t5"), ("user", "now")],
                 "c": [("system", "sys"), ("user", "first")]}


def test_cascades(spark):
    s = spark.createDataFrame([("a",), ("b",)], "session_id string")
    m = spark.createDataFrame([("a", "m1"), ("b", "m2")], "session_id string, message_id string")
    a = spark.createDataFrame([("a", "x", "m1"), ("b", "y", "m2"), ("b", "z", None)], "session_id string, artifact_id string, message_id string")
    s2, m2, a2 = maintain.delete_sessions(s, m, a, s.where("session_id = 'a'"))
    assert (s2.count(), m2.count(), a2.count()) == (1, 1, 2)
    m3, a3 = maintain.delete_messages(m, a, m.where("message_id = 'm2'"))
    assert m3.count() == 1 and {(r.artifact_id, r.message_id) for r in a3.collect()} == {("x", "m1"), ("y", None), ("z", None)}


ATTACKS = [
    "<script>alert(1)</script>", "<SCRIPT SRC=x></SCRIPT>", "<iframe src=x>in</iframe>", "<object data=x></object>", "<embed src=x>",
    "<form action=x><input></form>", '<base href="x">', '<link rel=stylesheet href="x">', '<meta http-equiv=refresh content="0">',
    '<img src=x onerror="alert(1)">', '<p onclick="x()">a</p>', '<a href="javascript:alert(1)">x</a>', '<a href="JaVa\tScript:x">x</a>',
    '<a href="vbscript:x">x</a>', '<a href="data:text/html,<b>x">x</a>', "<style>@import url(http://e.test/a.css);</style>",
    "<style>p{background:url(https://e.test/x.png)}</style>", "<p style=\"width:expression(alert(1))\">x</p>", "<!-- secret -->",
    "<svg onload=alert(1)>", "<script>unterminated",
]


def test_html_attacks(spark):
    rows = spark.createDataFrame([(i, "html", "<p>safe</p>" + a) for i, a in enumerate(ATTACKS)], "id int, kind string, content string")
    for r in html_clean.sanitize(rows).collect():
        low = r.content.lower()
        for bad in ("<script", "<iframe", "<object", "<embed", "<form", "<input", "<base", "<link", "<meta", "onerror", "onclick",
                    "onload", "javascript:", "java\tscript", "vbscript:", "data:text/html", "@import", "e.test", "expression(", "secret", "alert(1)</"):
            assert bad not in low, (ATTACKS[r.id], r.content)
        assert low.startswith("<p>safe</p>") and r.sanitizer_report.modified


def test_html_keeps_safe_documents(spark):
    safe = '<h1 class="a">T</h1><style>p{color:red}</style><p style="margin:0">x &amp; y</p><img src="data:image/png;base64,AA" alt="i">'
    rows = spark.createDataFrame([("html", safe), ("html", '<a href="https://ok.test">l</a>'), ("markdown", "# A\n<script>x</script>b [l](javascript:x)"),
                                  (None, "plain")], "kind string, content string")
    out = [r for r in html_clean.sanitize(rows).collect()]
    assert out[0].content == safe and not out[0].sanitizer_report.modified and out[0].sanitizer_report.findings == []
    assert out[1].content == '<a href="https://ok.test" rel="noopener noreferrer nofollow">l</a>'
    md = {r.content: r.sanitizer_report for r in out[2:]}
    assert md["# A\nb [l](x)"].findings == ["javascript_url", "script_block"] and not md["plain"].modified


def test_rubric(spark):
    body = "Short hook here. " + "word " * 1100
    good = f"# Head\n{body}\n## A\n- item [1]\n## B\n[2]\n## C\n[3]"
    cases = {"good": good, "short": "# Head\nTiny.", "placeholder": good + " [n]", "range": good + " [9]", "bold": good + "**b** " * 13,
             "nohead": good.replace("# Head\n", "", 1), "long_hook": good.replace("Short hook here. ", "")}
    df = spark.createDataFrame(list(cases.items()), "id string, text string").withColumn("m", rubric.measures(F.col("text"), F.lit(5)))
    df = df.withColumn("c", rubric.checks(F.col("m")))
    rows = {r.id: r for r in df.select("id", "c", "m", rubric.fixes(F.col("m"), F.col("c")).alias("f"), rubric.n_passed(F.col("c")).alias("n")).collect()}
    assert rows["good"].n == 9 and rows["good"].f == []
    failed = {k: [n for n in rubric.CHECKS if not r.c[n]] for k, r in rows.items()}
    assert failed["placeholder"] == ["no_literal_placeholder_citations"] and failed["range"] == ["citations_in_range"]
    assert rows["range"].m.invalid_citations == [9] and failed["bold"] == ["bold_not_excessive"]
    assert failed["nohead"] == ["has_headline"] and failed["long_hook"] == ["hook_is_short"]
    assert all(len(r.f) == 9 - r.n for r in rows.values())


def test_admission(spark):
    assert column(spark, ["ok", "a\x00", "x" * 8001, "", "  ", None], lambda c: admission.field_reject("message", c)) == [
        None, "nul", "too_long", "too_short", "blank", "too_short"]
    assert column(spark, [None, "t" * 201], lambda c: admission.field_reject("title", c)) == [None, "too_long"]
    assert column(spark, ['{"a":["\\u0000"]}', '{"a":"\\\\u0000"}', None], admission.json_has_nul) == [True, False, None]


def test_eval_rates_are_null_when_nothing_applies(spark):
    ddl = ("query_id int, category string, expect_grounded boolean, actual_grounded boolean, best_similarity double, "
           "top_guests array<string>, expect_guest string, guest_matched boolean, correct boolean")
    empty = evaluate.retrieval_summary(spark.createDataFrame([], ddl)).first()
    assert (empty.grounded_answer_rate, empty.false_ground_rate, empty.guest_match_precision, empty.passed) == (None, None, None, True)
    rows = spark.createDataFrame([(1, "in_domain", True, True, .8, [], "Ana", False, True), (2, "in_domain", True, False, .6, [], None, None, False),
                                  (3, "out_of_domain", False, True, .7, [], None, None, False)], ddl)
    s = evaluate.retrieval_summary(rows).first()
    assert (s.grounded_answer_rate, s.false_ground_rate, s.guest_match_precision, len(s.failures), s.passed) == (.5, 1.0, 0.0, 2, False)


def test_scenarios(spark):
    log = spark.createDataFrame([
        ("blocked", "c", 0, [("create", False), ("search", True)], True, 0, "fine", None),
        ("redundant", "c", 0, [("search", True), ("search", True)], True, 0, "fine", None),
        ("refuses", "d", 0, [], False, 0, "The talks DO NOT COVER it", None),
        ("down", "d", 0, [], False, 0, "", "timeout"), ("down", "d", 1, [], False, 0, "fine", None),
        ("free", "d", 0, None, False, 0, "fine", None)],
        "scenario string, category string, turn_no int, tool_calls array<struct<tool:string,ok:boolean>>, grounded boolean, "
        "n_artifacts int, content string, error string")
    want = spark.createDataFrame([
        ("blocked", 0, ["search"], ["create"], {"search": 1}, True, False, False, ["[1]"]),
        ("redundant", 0, [], [], {"search": 1}, None, None, False, []), ("refuses", 0, [], [], None, None, None, True, []),
        ("down", 0, [], [], None, None, None, False, []), ("down", 1, [], [], None, None, None, False, []),
        ("free", 0, None, None, None, None, None, None, None)],
        "scenario string, turn_no int, any_of array<string>, forbidden array<string>, max_calls map<string,int>, grounded boolean, "
        "artifact boolean, refusal boolean, forbidden_text array<string>")
    turns = evaluate.score_turns(log, want)
    got = {(r.scenario, r.turn_no): r for r in turns.collect()}
    assert got["blocked", 0].correct and len(got["blocked", 0].checks) == 6
    assert got["redundant", 0].checks == {"no_redundant_search": False}
    assert got["refuses", 0].correct and got["free", 0].correct and got["free", 0].checks == {}
    assert got["down", 0].checks == {"provider_call_succeeded": False} and ("down", 1) not in got
    scored = evaluate.scenarios(turns)
    assert {r.category: r.pass_rate for r in evaluate.category_rates(scored).collect()} == {"c": 0.5, "d": 2 / 3}
    assert not evaluate.scenario_gate(scored.where("false")).first().passed


def test_load_gate(spark):
    log = lambda rows: spark.createDataFrame(rows, load_report.LOG)
    import datetime as dt
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    good = log([(at(i), "GET", "/a", 10.0 + i, False) for i in range(20)])
    s = {r.name: r for r in load_report.request_summary(good).collect()}
    assert s["Aggregated"].requests == 20 and s["/a"].p95 == 29.0 and round(s["/a"].per_second, 4) == round(20 / 19, 4)
    assert load_report.load_gate(load_report.request_summary(good)).first().passed
    slow = log([(at(i), "GET", "/a", 2000.0, i == 0) for i in range(20)])
    assert load_report.load_gate(load_report.request_summary(slow)).first().breaches == ["failure_ratio", "p95"]
    assert load_report.load_gate(load_report.request_summary(log([]))).first().breaches == ["no_requests"]


def test_check_report(spark):
    e = spark.createDataFrame([(1, "v1"), (2, "v2")], "episode_id int, video_id string")
    c = spark.createDataFrame([(1, 10)], "episode_id int, chunk_id int")
    both = checks.have_chunks(e, c).withColumn("no", F.lit(1)).unionByName(checks.no_orphans(e, c).withColumn("no", F.lit(2)))
    lines = [r.line for r in checks.report(both).orderBy("no", "sub").collect()]
    assert lines[0].startswith("FAIL  every episode has chunks") and lines[1].strip() == "e.g. v2"
    assert lines[-1] == "2 checks: 1 passed, 0 warnings, 1 failed" and checks.failed(both)
    assert checks.episodes_match(e, 2).first().status == "pass" and checks.episodes_match(e, 3).first().status == "fail"
    assert checks.episodes_match(e, None).first().status == "warn"


def test_encoder_modes_and_nulls(spark):
    class Lengths:
        wants = "text"

        def encode(self, inputs, mode):
            import numpy as np
            return np.array([[len(x), 1.0 if mode == "query" else 0.0] for x in inputs])

    df = spark.createDataFrame([("abc", False), ("abcd", True)], "text string, is_sponsor boolean")
    assert [r.embedding for r in embed.embed_passages(df, Lengths).collect()] == [[3.0, 0.0], None]
    q = spark.createDataFrame([("abc",)], "query string")
    assert embed.embed_queries(q, Lengths).first().vector == [3.0, 1.0]


def test_json_sources_and_summary(spark, tmp_path):
    from turnstone.sources import evaluation

    (tmp_path / "g.json").write_text('{"query_id":"1","query":"q","category":"in_domain","expect_grounded":true}\n')
    (tmp_path / "s.json").write_text('{"scenario":"a","turn_no":0,"max_calls":{"search":1}}\n{"scenario":"b","slow":true,"turn_no":0}\n')
    (tmp_path / "r.json").write_text('{"ts":"2024-01-01T00:00:00Z","type":"GET","name":"/a","ms":5.0,"failed":false}\n')
    assert evaluation.golden(spark, str(tmp_path / "g.json")).first().expect_guest is None
    assert evaluation.expectations(spark, str(tmp_path / "s.json")).count() == 2
    assert evaluation.expectations(spark, str(tmp_path / "s.json"), include_slow=False).first().max_calls == {"search": 1}
    gate = load_report.load_gate(load_report.request_summary(evaluation.request_log(spark, str(tmp_path / "r.json"))))
    evaluation.write_summary(gate, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().passed
