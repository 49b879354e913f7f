"""The operators on vectors against plain sequential models."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.llm import collision_search, cover_codes, queries, vantage_clusters

SF = "/root/testdata/sf0.01"
CLASHING = ("id", "v", "n", "ids", "query_no", "query_id", "rank", "score", "cluster", "distance", "s", "at", "dim", "code", "error", "_label", "h")


def table(spark, rows, element="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, label int")
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def awkward(spark, dim=64):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-4, 5, (60, dim)) / 4.0
    rows = [(i, v.tolist(), i % 3 if i % 5 else None) for i, v in enumerate(vectors)]
    rows += [(200, rows[0][1], 1), (200, rows[0][1], 1), (300, rows[7][1], None), (None, rows[9][1], 2), (None, rows[9][1], 2)]
    bad = [(400, None, 1), (401, [], 1), (402, [None] + [1.0] * (dim - 1), 1), (403, [float("nan")] * dim, 1),
           (404, [float("inf")] + [0.5] * (dim - 1), 1), (405, [1.0] * 16, 1)]
    return rows, bad


def matrix(rows):
    return np.array([r[1] for r in rows])


# --- op11 ---------------------------------------------------------------------------------

def nearest(rows, k):
    """Rows (query_id, rank, vec_id, score) by comparing everything."""
    out, m = [], matrix(rows)
    ids = [r[0] for r in rows]
    for q, v, _ in rows:
        if q is None or q % 100:
            continue
        far = np.sqrt(((m - np.array(v)) ** 2).sum(axis=1))
        best = sorted((d, i is not None, i or 0) for d, i in zip(far, ids) if i != q)[:k]
        out += [(q, r + 1, i if known else None, d) for r, (d, known, i) in enumerate(best)]
    return sorted(out, key=str)


def test_search_awkward(spark):
    rows, bad = awkward(spark)
    zero = (500, [0.0] * 64, 1)
    got = collision_search.search(table(spark, rows + bad + [zero]), F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted(map(tuple, got), key=str) == nearest(rows, 10)
    assert collision_search.search(table(spark, []), F.col("vec_id") % 100 == 0, 10).count() == 0
    few = collision_search.search(table(spark, rows[:4]), F.col("vec_id") % 100 == 0, 10).collect()
    assert [(r.rank) for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3]


def test_search_dimensions_meet_their_own(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (100, [1.0, 0.0, 0.0], 0), (2, [0.0, 1.0, 0.0], 0)]
    got = {(r.query_id, r.vec_id) for r in collision_search.search(table(spark, rows), F.col("vec_id") % 100 == 0, 10).collect()}
    assert got == {(0, 1), (100, 2)}


def test_search_query_blocks(spark, monkeypatch):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = collision_search.search(e, F.col("vec_id") % 100 == 0, 10).collect()
    monkeypatch.setattr(collision_search, "QUERY_BYTES", 1024)
    assert sorted(collision_search.search(e, F.col("vec_id") % 100 == 0, 10).collect()) == sorted(whole)


def test_threshold_is_the_binomial_quantile():
    need = collision_search.threshold(128, 1.5, 0.05)
    draws = np.random.default_rng(0).binomial(128, 0.8663855974622838, 200_000)
    assert (draws < need).mean() <= 0.05 < (draws < need + 1).mean()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_search_recall(spark, sf):
    """Over 0.9 of the true neighbours; true distances; fewer vectors verified than there are."""
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 0) for r in e.collect()]
    true = {}
    for q, _, i, d in nearest(rows, 10):
        true.setdefault(q, {})[i] = d
    got = collision_search.search(e, F.col("vec_id") % 100 == 0, 10).collect()
    right = sum(r.vec_id in true[r.query_id] for r in got)
    assert len(got) == 10 * len(true) and right >= 0.9 * len(got)
    assert all(true[r.query_id][r.vec_id] == r.score for r in got if r.vec_id in true[r.query_id])


def test_search_leaves_out_far_vectors():
    """On clustered vectors a block verifies a small part of what it holds."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 64))
    m = np.vstack([c + 0.1 * rng.standard_normal((100, 64)) for c in centres])
    axes = collision_search.directions(64)
    orders = np.argsort(axes @ m.T, axis=1).astype(np.uint16)
    block = collision_search.Block({"n": 4000, "dim": 64, "ids": list(range(4000)), "wide": True,
                                    "vectors": m.tobytes(), "orders": orders.tobytes()}, axes)
    seen, right = 0, 0
    for q in range(0, 4000, 100):
        best = collision_search.Best(10)
        seen += block.search(m[q], axes @ m[q], q, best, collision_search.threshold())
        far = ((m - m[q]) ** 2).sum(axis=1)
        right += len(set(best.ids) & set([i for i in np.argsort(far) if i != q][:10]))
    assert right >= 0.9 * 400 and seen < 0.15 * 40 * 4000


# --- op12 ---------------------------------------------------------------------------------

def lloyd(rows, clusters, rounds, scale):
    ids = [r[0] for r in rows]
    v = np.floor(scale * matrix(rows)).astype(int)
    drawn = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x.tolist()) for i, x in zip(ids, v))
    c = np.array([x for _, x in drawn[:clusters]])
    near = lambda: ((v[:, None] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        a = near().argmin(axis=1)
        c = np.array([[int(s) // int((a == j).sum()) for s in v[a == j].sum(axis=0)] if (a == j).any() else c[j] for j in range(len(c))])
    far = near()
    a, d = far.argmin(axis=1), far.min(axis=1)
    return sorted(((i, int(j), int(x), int(d[a == j].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest())
                   for i, j, x in zip(ids, a, d)), key=str)


@pytest.mark.parametrize("take", [5, 20, 66])
def test_clusters_awkward(spark, take):
    rows, bad = awkward(spark)
    rows = rows[-take:]
    got = vantage_clusters.clusters(table(spark, rows + bad)).collect()
    assert sorted(map(tuple, got), key=str) == lloyd(rows, 16, 3, 64)


def test_clusters_empty(spark):
    none = vantage_clusters.clusters(table(spark, []))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_refuse_what_a_long_cannot_hold(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        vantage_clusters.clusters(table(spark, [(1, [1e9] * 64, 0)])).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=1, max_size=40), st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=1, max_size=30))
def test_vantage_tree_ties(centroids, vectors):
    """Many equal distances and equal centroids: the smaller number always wins."""
    c, v = np.array(centroids, np.int64), np.array(vectors, np.int64)
    number, best, compared = vantage_clusters.Tree.over(c).nearest(v)
    far = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert number.tolist() == far.argmin(axis=1).tolist() and best.tolist() == far.min(axis=1).tolist()
    assert compared <= len(c) * len(v)


def test_vantage_tree_prunes():
    rng = np.random.default_rng(1)
    c = rng.integers(-1000, 1000, (64, 2))
    v = rng.integers(-1000, 1000, (500, 2))
    assert vantage_clusters.Tree.over(c).nearest(v)[2] < 0.4 * 64 * 500


# --- op13 ---------------------------------------------------------------------------------

def books_and_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    ids = [r[0] for r in rows]
    v = np.floor(scale * matrix(rows)).astype(int)
    first = sorted(range(len(rows)), key=lambda i: (ids[i] is None, ids[i] or 0, v[i].tolist()))[:entries]
    code, error, books = [], 0, []
    for p in np.split(v, parts, axis=1):
        b = p[first]
        near = lambda p=p: ((p[:, None] - b[None]) ** 2).sum(axis=2)
        for _ in range(rounds):
            a = near().argmin(axis=1)
            b = np.array([[int(s) // int((a == j).sum()) for s in p[a == j].sum(axis=0)] if (a == j).any() else b[j] for j in range(len(b))])
        code.append(near().argmin(axis=1))
        error = error + near().min(axis=1)
        books += b.ravel().tolist()
    labels = [r[2] for r in rows]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((i, "".join(f"{c[n]:02x}" for c in code), int(error[n]),
                    int(sum(e for e, lb in zip(error, labels) if lb == labels[n])), digest) for n, i in enumerate(ids)), key=str)


@pytest.mark.parametrize("take", [3, 17, 66])
def test_codes_awkward(spark, take):
    rows, bad = awkward(spark)
    rows = rows[-take:]
    got = cover_codes.codes(table(spark, rows + bad)).collect()
    assert sorted(map(tuple, got), key=str) == books_and_codes(rows)


def test_codes_empty(spark):
    assert cover_codes.codes(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        cover_codes.codes(table(spark, [(1, [1.0] * 9, 0)]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=200),
       st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=8))
def test_cover_tree(points, entries):
    """Nets nest, cover and keep apart; sums are those below; assignment equals brute force."""
    p, e = np.array(points, np.int64), np.array(entries, np.int64)
    tree = cover_codes.Tree.over(p)
    assert tree.count[0] == len(p) and tree.total[0].tolist() == p.sum(axis=0).tolist()
    for node in range(len(tree.centre)):
        below, at = [], [node]
        while at:
            this = at.pop()
            below += tree.point[tree.start[this]:tree.start[this + 1]].tolist()
            at += tree.child[tree.first[this]:tree.first[this + 1]].tolist()
        far = np.sqrt(((p[below] - p[tree.centre[node]]) ** 2).sum(axis=1))
        assert len(below) == tree.count[node] and far.max(initial=0) <= tree.radius[node]
    count, total, code, error, _ = tree.assign(e, each=True)
    far = ((p[:, None] - e[None]) ** 2).sum(axis=2)
    a = far.argmin(axis=1)
    assert code.tolist() == a.tolist() and error.tolist() == far.min(axis=1).tolist()
    assert count.tolist() == np.bincount(a, minlength=len(e)).tolist()
    assert total.tolist() == [p[a == j].sum(axis=0).tolist() for j in range(len(e))]


def test_cover_tree_settles_subtrees():
    """Clustered points: most are assigned without a comparison of their own."""
    rng = np.random.default_rng(2)
    p = np.vstack([c + rng.integers(-20, 21, (200, 4)) for c in rng.integers(-5000, 5000, (10, 4))])
    tree = cover_codes.Tree.over(p)
    assert tree.assign(p[::200].copy())[4] < 0.1 * len(p) * 10
    packed = cover_codes._unpack(cover_codes._pack([tree]), 1)[0]
    assert all(np.array_equal(getattr(packed, f), getattr(tree, f)) for f in cover_codes.FIELDS)


def test_cover_tree_net():
    """A level's points are over its scale apart, and each later point hangs within the scale."""
    p = np.random.default_rng(4).integers(-1000, 1000, (500, 3))
    order, level, hangs = cover_codes._farthest_first(p, 60)
    top = np.sqrt(((p[order[1]] - p[order[0]]) ** 2).sum())
    for lv in range(1, level.max() + 1):
        net = p[order[level <= lv]]
        far = np.sqrt(((net[:, None] - net[None]) ** 2).sum(axis=2))
        assert far[~np.eye(len(net), dtype=bool)].min(initial=np.inf) >= top / 2**lv
        new = np.flatnonzero(level == lv)
        assert (np.sqrt(((p[order[new]] - p[order[hangs[new]]]) ** 2).sum(axis=1)) <= top / 2 ** (lv - 1)).all()


@pytest.mark.parametrize("name", ["op11_collision_search", "op12_vantage_clusters", "op13_cover_codes"])
def test_columns(spark, name):
    wanted = {"op11_collision_search": ["query_id", "rank", "vec_id", "score"],
              "op12_vantage_clusters": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
              "op13_cover_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"]}
    assert queries.QUERIES[name](spark, SF).columns == wanted[name]
