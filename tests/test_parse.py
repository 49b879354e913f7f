"""Layouts, advertisement flags and packing, on literal transcripts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from turnstone.operators import ad_blocks, pack, parse
from turnstone.settings import Settings
from turnstone.sources import transcripts


def turns_of(spark, bodies, settings=Settings()):
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    rows = parse.parse_turns(df, "body", settings).select("k", "turns").collect()
    return {r.k: [tuple(t) for t in r.turns] for r in rows}


def test_layouts(spark):
    bodies = [
        "intro dropped\nAna Bell (00:00:05):\nHello there.\n\nSecond paragraph.\nRex (00:01:00):\nHi.",
        "Ana Bell (1:05):\nOnly minutes.",
        "Ana Bell (0:05):\nStart.\n(00:30):\nStill Ana.\nRex (1:00):\nNow Rex.",
        "(00:05):\nNobody named.\nRex (1:00):\nRex.",
        "[00:00:05] Ana Bell: Inline text.\n[00:10] and more\nloose line\n[00:20] Rex: Done.",
        "Ana Bell:\nNo times here.\nthis line ends with a colon:\nRex:\nFine.",
        "Ana Bell (0:05):\nTimed.\nRex:\nStays text.",
        "nothing to see",
        "Ana (0:01):\n\nRex (0:02):\nEmpty turn before.",
        "Ana (0:01):\r\nDos line.\r\nRex (0:02):\r\nOther.",
        "Ana (0:01):\nfirst second",
        None,
    ]
    got = turns_of(spark, bodies)
    assert got[0] == [("Ana Bell", 5, "Hello there.\n\nSecond paragraph.", False),
                      ("Rex", 60, "Hi.", False)]
    assert got[1] == [("Ana Bell", 65, "Only minutes.", False)]
    assert got[2] == [("Ana Bell", 5, "Start.\nStill Ana.", False), ("Rex", 60, "Now Rex.", False)]
    assert got[3] == [("Unknown speaker", 5, "Nobody named.", False), ("Rex", 60, "Rex.", False)]
    assert got[4] == [("Ana Bell", 5, "Inline text.\nand more\nloose line", False),
                      ("Rex", 20, "Done.", False)]
    assert got[5] == [("Ana Bell", None, "No times here.\nthis line ends with a colon:", False),
                      ("Rex", None, "Fine.", False)]
    assert got[6] == [("Ana Bell", 5, "Timed.\nRex:\nStays text.", False)]
    assert got[7] == [] and got[11] == []
    assert got[8] == [("Rex", 2, "Empty turn before.", False)]
    assert got[9] == [("Ana", 1, "Dos line.", False), ("Rex", 2, "Other.", False)]
    assert got[10] == [("Ana", 1, "first\nsecond", False)]


def test_long_hour_clock(spark):
    assert turns_of(spark, ["A (01:02:03):\nx"])[0][0][1] == 3723


def test_multi_paragraph_ad_is_one_turn(spark):
    body = ("Host (0:01):\nThis episode is brought to you by Acme.\n(0:20):\nHead over to acme.test.\n"
            "Host (0:40):\nUse code POD.\nHost (0:50):\nSo, pricing.\nHost (0:55):\nvisit us")
    assert [t[3] for t in turns_of(spark, [body])[0]] == [True, True, False, False]


def sequential_flags(turns):
    open_by, flags = None, []
    for speaker, kind in turns:
        if kind == "o":
            open_by = speaker
            flags.append(True)
        elif kind == "f" and open_by == speaker:
            flags.append(True)
        else:
            open_by = None
            flags.append(False)
    return flags


TEXT = {"o": "sponsored by x", "f": "use code y", "x": "plain"}


def test_ad_rule_matches_sequential_model_in_rows_and_in_tables(spark):
    rng = random.Random(3)
    cases = [list(c) for n in range(1, 4) for c in itertools.product(itertools.product("AB", "ofx"), repeat=n)]
    cases += [[(rng.choice("AB"), rng.choice("ofx")) for _ in range(rng.randint(4, 40))] for _ in range(150)]
    bodies = ["\n".join(f"{s} (0:01):\n{TEXT[k]}" for s, k in c) for c in cases]
    got = turns_of(spark, bodies)
    rows = [(i, n, s, TEXT[k]) for i, c in enumerate(cases) for n, (s, k) in enumerate(c)]
    table = spark.createDataFrame(rows, "k int, n int, speaker string, text string")
    # blocks of three rows, so that advertisements cross block borders
    flagged = ad_blocks.flag_ad_turns(table, ["k"], "n", block=F.floor(F.col("n") / 3))
    by_case = {}
    for r in flagged.select("k", "n", "is_sponsor").collect():
        by_case.setdefault(r.k, {})[r.n] = r.is_sponsor
    for i, c in enumerate(cases):
        want = sequential_flags(c)
        assert [t[3] for t in got[i]] == want, c
        assert [by_case[i][n] for n in range(len(c))] == want, c


def sequential_pack(turns, target, overlap):
    """The packing rule told turn by turn, to compare with the span form."""
    est = pack.tokens
    parts = []
    for t in turns:
        if est(t["text"]) <= target:
            parts.append(t)
            continue
        held, used = [], 0
        for s in pack._SENTENCE_END.split(t["text"]):
            if held and used + est(s) > target:
                parts.append({**t, "text": " ".join(held)})
                held, used = [], 0
            held.append(s)
            used += est(s)
        parts.append({**t, "text": " ".join(held)})
    out, held, used = [], [], 0
    for t in parts:
        if held and held[0]["is_sponsor"] != t["is_sponsor"]:
            out.append(held)
            held, used = [], 0
        if held and used + est(t["text"]) > target:
            out.append(held)
            carry, used = [], 0
            for h in reversed(held):
                if used + est(h["text"]) > overlap:
                    break
                carry.insert(0, h)
                used += est(h["text"])
            held = carry
        held = [*held, t]
        used += est(t["text"])
    return out + [held] if held else out


def random_turns(rng):
    n = rng.randint(0, 25)
    words = [" ".join(rng.choice(["a", "b.", "c!", "dd"]) for _ in range(rng.choice([1, 5, 30, 60, 400])))
             for _ in range(n)]
    return [{"speaker": rng.choice("AB"), "start_seconds": i, "text": w, "is_sponsor": rng.random() < .2}
            for i, w in enumerate(words)]


@pytest.mark.parametrize("seed", range(60))
def test_packing_matches_sequential_model(seed):
    rng = random.Random(seed)
    turns = random_turns(rng)
    target, overlap = rng.choice([(400, 80), (60, 20), (10, 30), (40, 0)])
    want = sequential_pack(turns, target, overlap)
    got = pack.pack(turns, target, overlap)
    assert [c["text"] for c in got] == [
        "\n\n".join(f"{t['speaker']}: {t['text']}" for t in g) for g in want]
    assert [c["ordinal"] for c in got] == list(range(len(got)))
    assert [(c["start_seconds"], c["end_seconds"]) for c in got] == [
        (g[0]["start_seconds"], g[-1]["start_seconds"]) for g in want]


def test_packing_bounds():
    turn = lambda w, ad=False: {"speaker": "S", "start_seconds": 1, "text": w, "is_sponsor": ad}
    hundred = " ".join(["w"] * 100)
    chunks = pack.pack([turn(hundred)] * 20, 400, 80)
    assert len(chunks) > 1 and all(c["token_count"] <= 560 for c in chunks)
    long = pack.pack([turn(" ".join(["One short sentence here."] * 400))], 400, 80)
    assert len(long) > 3 and all(c["token_count"] <= 560 for c in long)
    mixed = pack.pack([turn("ad", True), turn("talk")], 400, 80)
    assert [c["is_sponsor"] for c in mixed] == [True, False]


def test_pack_chunks_in_spark(spark):
    df = spark.createDataFrame([("e1", "A (0:01):\nHello.\nB (0:09):\nThere."), ("e2", "no turns")],
                               "episode_id string, body string")
    rows = pack.pack_chunks(parse.parse_turns(df), "episode_id").collect()
    assert [(r.episode_id, r.ordinal, r.speaker, r.start_seconds, r.end_seconds, r.text, r.token_count)
            for r in rows] == [("e1", 0, "A", 1, 9, "A: Hello.\n\nB: There.", 5)]


FULL = """---
guest: Ana Bell
title: "On pricing: part 1"
youtube_url: https://v.test/watch?v=abc
video_id: abc
publish_date: 2023-05-17
duration_seconds: 3600.5
description: All of it
keywords: [pricing, growth]
---
Ana (0:01):
Body --- with dashes.
"""


def test_front_matter(spark):
    empty = "---\nvideo_id: ''\nkeywords: a, b ,\npublish_date: '2023-13-01'\nduration_seconds: soon\n---\nx"
    files = spark.createDataFrame([
        ("/e/one/transcript.md", FULL), ("/e/two/transcript.md", empty),
        ("/e/three/transcript.md", "no front matter"), ("/e/four/transcript.md", "---\nguest: x\n"),
        ("/e/five/transcript.md", "---\n: [bad\n---\nx"), ("/e/six/transcript.md", FULL.replace("\n", "\r\n")),
        ("/e/seven/transcript.md", "---\nvideo_id: 123\npublish_date: '2024-01-02'\n---\n"),
    ], "source_path string, raw string")
    good, bad = transcripts.parse_files(files)
    g = {r.source_path.split("/")[2]: r for r in good.collect()}
    assert {(r.source_path.split("/")[2], r.error) for r in bad.collect()} == {
        ("three", "missing"), ("four", "unterminated"), ("five", "yaml")}
    one = g["one"]
    assert (one.video_id, one.guest, one.title, one.youtube_url, str(one.publish_date),
            one.duration_seconds, one.description, one.keywords) == (
        "abc", "Ana Bell", "On pricing: part 1", "https://v.test/watch?v=abc", "2023-05-17",
        3600.5, "All of it", ["pricing", "growth"])
    assert "Body --- with dashes." in one.body
    two = g["two"]
    assert (two.video_id, two.guest, two.title, two.youtube_url, two.publish_date,
            two.duration_seconds, two.keywords) == (
        "slug:two", "Unknown guest", "Untitled episode", "", None, None, ["a", "b"])
    assert g["six"].content_hash == one.content_hash
    assert (g["seven"].video_id, g["seven"].youtube_url, str(g["seven"].publish_date)) == (
        "123", "https://www.youtube.com/watch?v=123", "2024-01-02")
