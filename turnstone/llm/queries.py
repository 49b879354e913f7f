"""The registered queries of this folder, with their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import (attention_quality, collision_search, cover_codes, heavy_dedup, hilbert_shards, order_minhash, pitman_yor,
                           rank_queue_bpe, secret_scan, token_counts, url_rules, vantage_clusters, window_match)
from turnstone.llm.common import crc_mod, shared_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dims = [F.col("lang"), F.col("source"), F.coalesce(F.octet_length("text"), F.lit(0)), F.col("doc_id")]
    return hilbert_shards.assign(docs, dims)


def op2_order_minhash(spark, sf_dir) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op3_rank_queue_bpe(spark, sf_dir) -> DataFrame:
    ids = rank_queue_bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return rank_queue_bpe.decode(ids, RANKS, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_rules(spark, sf_dir) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                              ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS rverdict
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""


def op5_heavy_dedup(spark, sf_dir) -> DataFrame:
    return heavy_dedup.groups(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
"""


def op6_attention_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = attention_quality.fit(docs, table(spark, sf_dir, "labels"))
    return attention_quality.score(docs, model)


def op7_token_counts(spark, sf_dir) -> DataFrame:
    """A cache of this run's own, so that every content is met for the first time."""
    return token_counts.counts(table(spark, sf_dir, "documents"), VOCABULARY, shared_path(spark, "token-cache"))


def op8_secret_scan(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = list(dict.fromkeys([*secret_scan.WORDS, *secret_scan.frequent_words(docs)]))
    return secret_scan.scan(docs, words)


def op9_window_match(spark, sf_dir) -> DataFrame:
    return window_match.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH norm AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, list_filter(w, lambda x: x <> '') AS w FROM norm),
inorm AS (SELECT item_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, list_filter(w, lambda x: x <> '') AS w FROM inorm),
win AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda s: array_to_string(w[s:s + 12], ' '))) AS win, least(len(w), 13) AS len
        FROM i WHERE len(w) > 0),
lens AS (SELECT DISTINCT len FROM win),
pos AS (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS s FROM d, lens WHERE len(w) >= len),
hit AS (SELECT DISTINCT doc_id, s, pos.len, item_id FROM pos JOIN win ON win.len = pos.len AND win.win = array_to_string(w[s:s + pos.len - 1], ' ')),
words AS (SELECT DISTINCT doc_id, unnest(range(s, s + len)) AS p FROM hit),
nw AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nw ON d.doc_id = nw.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""


def op10_pitman_yor(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pitman_yor.fit(docs.where(crc_mod("doc_id", 7) != 2))
    return pitman_yor.score(docs, model)


def op11_collision_search(spark, sf_dir) -> DataFrame:
    return collision_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op12_vantage_clusters(spark, sf_dir) -> DataFrame:
    return vantage_clusters.clusters(table(spark, sf_dir, "embeddings"))


SQUARES = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
FLOOR_MEAN = "CAST(({s} - (({s} % {n}) + {n}) % {n}) // {n} AS BIGINT)"  # // goes towards zero


def _usable(more: str = "TRUE") -> str:
    return f"embedding IS NOT NULL AND {more} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op12_sql() -> str:
    """Lloyd's rounds as a chain of tables: nearest centroid of each vector, then the means."""
    far, mean = SQUARES.format(a="k.v", b="c.v"), FLOOR_MEAN.format(s="s", n="n")
    ctes = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {_usable("len(embedding) = 64")}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 16)"""]
    for i in range(vantage_clusters.ROUNDS + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, k.v AS v, c, CAST({far} AS BIGINT) AS d FROM kept k, c{i} c
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if i < vantage_clusters.ROUNDS:
            ctes.append(f"""s{i} AS (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p),
m{i} AS (SELECT c, list({mean} ORDER BY p) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    last = vantage_clusters.ROUNDS
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} ON c{last}.c = a.c"""


def op13_cover_codes(spark, sf_dir) -> DataFrame:
    return cover_codes.codes(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """The same, in every part; an entry is (part, number). The tables are 64 wide."""
    far, mean = SQUARES.format(a="k.v", b="c.v"), FLOOR_MEAN.format(s="s", n="n")
    ctes = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS whole
  FROM embeddings WHERE {_usable("len(embedding) > 0")}),
cut AS MATERIALIZED (SELECT vec_id, label, p, whole[p * 8 + 1:p * 8 + 8] AS v FROM kept, range(8) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, v FROM cut QUALIFY c < 16)"""]
    for i in range(cover_codes.ROUNDS + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, label, k.p AS p, k.v AS v, c, CAST({far} AS BIGINT) AS d FROM cut k JOIN c{i} c ON c.p = k.p
  QUALIFY row_number() OVER (PARTITION BY vec_id, k.p ORDER BY d, c) = 1)""")
        if i < cover_codes.ROUNDS:
            ctes.append(f"""s{i} AS (SELECT p, c, j, sum(x) AS s, count(*) AS n
  FROM (SELECT p, c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY p, c, j),
m{i} AS (SELECT p, c, list({mean} ORDER BY j) AS v FROM s{i} GROUP BY p, c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.p, c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.p = c{i}.p AND m{i}.c = c{i}.c)""")
    last = cover_codes.ROUNDS
    return "WITH " + ",\n".join(ctes) + f""",
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS h FROM c{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM coded"""


QUERIES = {f.__name__: f for f in (
    op1_hilbert_shards, op2_order_minhash, op3_rank_queue_bpe, op4_url_rules, op5_heavy_dedup, op6_attention_quality,
    op7_token_counts, op8_secret_scan, op9_window_match, op10_pitman_yor, op11_collision_search, op12_vantage_clusters,
    op13_cover_codes)}
ORACLES = {"op4_url_rules": OP4_SQL, "op5_heavy_dedup": OP5_SQL, "op9_window_match": OP9_SQL,
           "op12_vantage_clusters": _op12_sql(), "op13_cover_codes": _op13_sql()}
