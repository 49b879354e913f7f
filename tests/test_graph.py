"""The neighbour graph: built, stored, searched; what it finds and what it leaves alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.operators import graph, vector
from turnstone.plans.catalog import search as registered
from turnstone.plans.catalog import tables as t

SMALL = graph.Shape(block=64, top=40, shrink=4, lists=16)


def table(spark, m, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(np.asarray(m))], "chunk_id long, embedding array<float>")


def asked(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.asarray(m))], "query_id long, vector array<float>")


def pairs(df):
    return {(r.query_id, r.chunk_id) for r in df.collect()}


@pytest.fixture(scope="module")
def sheet(spark):
    """Vectors near a six-dimensional sheet in 32 dimensions, as texts about related things are."""
    rng = np.random.default_rng(11)
    m = rng.standard_normal((4000, 6)) @ rng.standard_normal((6, 32)) + 0.05 * rng.standard_normal((4000, 32))
    return m, table(spark, m).cache()


def test_graph_in_layers_finds_neighbours_scoring_few(spark, sheet, tmp_path):
    m, chunks = sheet
    built = graph.build(chunks, str(tmp_path / "g"), graph.Shape(block=512, top=64, shrink=8))
    assert len(built.edges) == 2 and built.vectors.count() == 4000
    q = asked(spark, m[:60] + 0.01)
    want = pairs(vector.nearest(q, chunks, 30, filtered=False))
    scored = graph.scored(q, built, 48)
    assert len(pairs(graph.answers(scored, built, 30)) & want) >= 0.9 * len(want)
    assert scored.count() + 60 * built.top.count() <= 0.15 * 60 * 4000
    again = graph.read(spark, str(tmp_path / "g"))
    assert again.edges[0].count() == 4000 and again.edges[0].select(F.max(F.size("neighbours"))).first()[0] <= 32


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf, tmp_path):
    chunks, q = t.chunks(spark, f"/root/testdata/{sf}").cache(), t.queries(spark, f"/root/testdata/{sf}")
    built = graph.build(chunks, str(tmp_path / "g"))
    want = pairs(vector.nearest(q, chunks, 30, filtered=False))
    scored = graph.scored(q, built, registered.GRAPH_WIDTH)
    assert len(pairs(graph.answers(scored, built, 30)) & want) >= 0.9 * len(want)
    assert scored.groupBy("query_id", "node").count().where("count > 1").isEmpty()  # nothing is scored twice


def test_copies_are_one_node(spark, tmp_path):
    m = np.vstack([np.tile([1.0, 0.0, 0.0], (300, 1)), np.eye(3)[1:], [[0.9, 0.1, 0.0]]])
    built = graph.build(table(spark, m), str(tmp_path / "g"), SMALL)
    assert built.vectors.count() == 4 and built.members.count() == 303
    got = graph.search(asked(spark, [[1.0, 0.0, 0.0]]), built, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in got] == [(i, i + 1) for i in range(5)]
    few = graph.search(asked(spark, [[0.0, 1.0, 0.0]]), built, 303).collect()
    assert len(few) == 303 and {r.chunk_id for r in few} == set(range(303))


def test_odd_tables(spark, tmp_path):
    none = graph.build(table(spark, []), str(tmp_path / "none"))
    q = asked(spark, [[1.0, 0.0]]).unionByName(spark.createDataFrame([(9, None)], "query_id long, vector array<float>"))
    assert graph.search(q, none, 3).count() == 0
    one = graph.build(table(spark, [[0.5, 0.5]]), str(tmp_path / "one"))
    assert [(r.query_id, r.chunk_id, r.similarity) for r in graph.search(q, one, 3).collect()] == [(0, 0, 0.707106781)]
    sponsored = table(spark, [[0.5, 0.5], [0.4, 0.5]]).withColumn("is_sponsor", F.col("chunk_id") == 0)
    assert {r.chunk_id for r in graph.search(q, graph.build(sponsored, str(tmp_path / "ad")), 3).collect()} == {1}


def test_mutual_edges_and_pruning(spark, sheet):
    _, chunks = sheet
    nodes = chunks.limit(300).select(F.col("chunk_id").alias("node"), F.col("embedding").alias("vec"))
    edges = {r.node: set(r.neighbours) for r in graph._edges(nodes, 300, graph.Shape(degree=6)).collect()}
    assert len(edges) == 300 and max(map(len, edges.values())) <= 12
    assert sum(a in edges[b] for a in edges for b in edges[a]) >= 0.9 * sum(map(len, edges.values()))
