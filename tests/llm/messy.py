"""A small table with everything awkward in it."""

from pyspark.sql import functions as F

BODY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 3
CLASHING = ("digest", "row", "key", "words", "score", "label", "size", "curve", "kept", "host", "_rank", "_0", "_text",
            "node", "ids", "n", "a", "b", "word", "part", "winner", "group_size", "text_crc32", "_bad")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    many = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [
        (1, BODY, "en", "src0", 1), (2, BODY, "en", "src0", 1), (3, BODY.upper(), None, "src1", 1),
        (4, BODY + "one more tail", "fr", None, 1), (5, "", "en", "src0", 0), (6, None, None, None, None),
        (7, "short", "en", "src0", 1), (7, "short", "en", "src0", 1), (7, "another text under the same id", "de", "src2", 1),
        (None, "a text without an id", "de", "src2", 1), (None, "a text without an id", "de", "src2", 1),
        (8, many, "en", "src3", 1), (9, "é" * 5000, "fr", "src3", 1), (10, "!!! ... ???", "en", "src4", 1),
        (11, "!!! ... ?!?", "en", "src4", 1), (12, "x" * 20_000, "en", "src4", 1), (13, "\u00a0 \x1c\x00 \ud7ff 𝒜 mixed\tspace\n", "es", "src5", 1),
    ]


def documents(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def empty(spark):
    return documents(spark).where("false")
