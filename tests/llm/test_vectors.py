import numpy as np
import pytest

import brute
from tapeloom.llm import covertree as ct
from tapeloom.llm import neardup, suite, topk


def clustered(n=600, d=8, seed=0):
    """Random points, tight clusters, a chain and copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[100:200] = x[0] + rng.normal(size=(100, d)) * 0.05
    x[200:260] = x[1] + rng.normal(size=(60, d)) * 0.3
    angle = np.arange(60) * 0.25
    x[260:320] = 0
    x[260:320, 0], x[260:320, 1] = np.cos(angle), np.sin(angle)
    x[320:400] = x[5]
    return x


def test_trees_cover_and_nest():
    x = clustered()
    tree = ct.Tree.build(np.arange(len(x)), np.ones(len(x), int), x)
    assert sorted(tree.ids.tolist()) == list(range(len(x))) and np.allclose(tree.points, x[tree.ids])
    for k in range(len(tree.begin)):
        points = tree.points[tree.begin[k] : tree.end[k]]
        assert ct.distances(points, points[:1]).max() <= tree.radius[k] + 1e-6
        kids = np.arange(tree.child[k], tree.last[k])
        if len(kids):
            assert tree.begin[kids[0]] == tree.begin[k] and tree.end[kids[-1]] == tree.end[k]
            assert (tree.begin[kids[1:]] == tree.end[kids[:-1]]).all()
            assert (tree.radius[kids] <= tree.radius[k] / 2 + 1e-6).all()
        else:
            assert tree.end[k] - tree.begin[k] == 1
    again = ct.Tree.of(tree.blobs())
    assert (again.ids == tree.ids).all() and (again.radius == tree.radius).all()


def links_of(ids, x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= cosine) & ~np.eye(len(x), dtype=bool)
    up = brute.components(len(x), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    return {int(i): (int(n), int(ids[u])) for i, n, u in zip(ids, near.sum(axis=1), up)}


@pytest.mark.parametrize("cell", [4096, 64])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(ct, "CELL", cell)
    x = clustered().astype(np.float32)
    rows = [(int(k), [float(v) for v in p], 1) for k, p in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    want = links_of(np.arange(len(x)), x.astype(float))
    assert got == {k: (n, c, k == c) for k, (n, c) in want.items()}


ODD = [
    (1, [1.0, 0.0]),
    (2, [1.0, 0.01]),
    (3, None),
    (4, []),
    (5, [0.0, 0.0]),
    (6, [float("nan"), 1.0]),
    (7, [float("inf"), 1.0]),
    (8, [None, 1.0]),
    (9, [1.0, 0.0, 0.0]),
    (10, [2.0, 0.0]),
    (2, [1.0, 0.01]),
    (None, [0.0, 1.0]),
    (12, [-3.0, 0.5]),
]


def test_odd_vectors_link_with_nothing(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    rows = neardup.near_duplicates(df).collect()
    assert len(rows) == len(ODD)
    alone = {r.vec_id: (r.n_links, r.component_id) for r in rows if r.vec_id in (3, 4, 5, 6, 7, 8, 9, 12)}
    assert alone == {k: (0, k) for k in (3, 4, 5, 6, 7, 8, 9, 12)}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows if r.vec_id in (1, 2, 10)) == [(1, 3, 1), (2, 3, 1), (2, 3, 1), (10, 3, 1)]
    assert neardup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_op8_equals_brute_force(spark, folder):
    t = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in suite.QUERIES["op8_cover_tree_near_duplicates"](spark, folder).collect()}
    assert got == links_of(np.array([r.vec_id for r in t]), np.array([r.embedding for r in t], float))


def best(ids, v, q, k):
    score = v @ v[q]
    others = [i for i in range(len(ids)) if ids[i] != ids[q]]
    return [(r + 1, int(ids[i]), int(score[i])) for r, i in enumerate(sorted(others, key=lambda i: (-score[i], ids[i]))[:k])]


def test_op9_equals_brute_force(spark, folder):
    t = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in t]), np.floor(64 * np.array([r.embedding for r in t], float))
    got = {}
    for r in suite.QUERIES["op9_dual_tree_top_k"](spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {int(ids[q]): best(ids, v, q, 20) for q in range(len(ids)) if ids[q] % 20 == 0}


@pytest.mark.parametrize("cell", [4096, 64])
def test_search_prunes_without_losing_ties(spark, monkeypatch, cell):
    monkeypatch.setattr(ct, "CELL", cell)
    x = clustered(500, 4, 3)
    df = spark.createDataFrame([(int(k), [float(a) for a in p]) for k, p in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, "vec_id % 7 = 0", k=15, scale=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = np.floor(3 * x)
    assert {q: sorted(r) for q, r in got.items()} == {q: best(np.arange(len(x)), v, q, 15) for q in range(0, len(x), 7)}


def test_odd_vectors_take_no_part(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    rows = topk.top_k(df, "vec_id % 2 = 0", k=20, scale=1).collect()
    assert {r.query_id for r in rows} == {2, 10, 12}
    assert {r.vec_id for r in rows} == {1, 2, 10, 12, 5} - set() or {r.vec_id for r in rows} == {1, 2, 5, 10, 12}
    assert topk.top_k(df.where("vec_id < 0"), "true").count() == 0


def mixed_lengths():
    """Vectors of three lengths, each with near copies; ids go round the lengths."""
    rows = []
    for at, width in enumerate((3, 5, 8)):
        x = clustered(450, width, 5 + at)
        rows += [(3 * k + at, [float(a) for a in p]) for k, p in enumerate(x)]
    return rows


def test_every_length_is_compared_by_itself(spark):
    rows = mixed_lengths()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(df).collect()}
    want = {}
    for at in range(3):
        part = [(i, v) for i, v in rows if i % 3 == at]
        want |= links_of(np.array([i for i, _ in part]), np.array([v for _, v in part]))
    assert got == want and any(n for n, _ in got.values())


def test_queries_meet_their_own_length(spark):
    rows = mixed_lengths()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, "vec_id % 4 = 0", k=7, scale=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {}
    for at in range(3):
        part = [(i, v) for i, v in rows if i % 3 == at]
        ids, v = np.array([i for i, _ in part]), np.floor(16 * np.array([v for _, v in part]))
        want |= {int(ids[q]): best(ids, v, q, 7) for q in range(len(ids)) if ids[q] % 4 == 0}
    assert {q: sorted(x) for q, x in got.items()} == want
