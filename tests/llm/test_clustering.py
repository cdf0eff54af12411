"""Clustering by filtering kd-trees against plain Lloyd rounds in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from wordmill.llm import clustering
from wordmill.llm.clustering import Tree


def nearest(x, centroids):
    d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
    return d.index(min(d)), min(d)


def plain(rows, k=16, rounds=3, dim=64, scale=64):
    kept = [(i, [math.floor(scale * float(v)) for v in e]) for i, e in rows if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=mark)[:k]]
    for _ in range(rounds):
        homes = [nearest(x, centroids)[0] for _, x in kept]
        for z in range(len(centroids)):
            own = [x for h, (_, x) in zip(homes, kept) if h == z]
            if own:
                centroids[z] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *nearest(x, centroids)) for i, x in kept]
    total = {}
    for _, z, d in found:
        total[z] = total.get(z, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, z, d, total[z], sum(total.values()), sha[z]) for i, z, d in found), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)


def got(spark, rows, **more):
    out = clustering.cluster(table(spark, rows), **more)
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", range(12))
def test_trees_assign_and_sum_like_a_full_comparison(seed):
    rng = np.random.default_rng(seed)
    dim = int(rng.integers(1, 9))
    middles = rng.integers(-200, 200, (6, dim))
    x = (middles[rng.integers(0, 6, 700)] + rng.integers(-12, 13, (700, dim))).astype(np.int64)
    x[:150] = x[0]  # copies
    c = np.concatenate([middles, x[:3], x[:1]])  # some equal ones
    order, tree = Tree.planted(x)
    again = Tree.unpacked(dim, *tree.packed())
    assert np.array_equal(again.x, x[order])
    want = np.array([nearest(v, c.tolist())[0] for v in x[order].tolist()])
    home, whole = again.filtered(c)
    assert np.array_equal(home, want)
    assert whole  # clustered vectors are assigned by the node
    n, sums = again.totals(c)
    assert np.array_equal(n, np.bincount(want, minlength=len(c)))
    assert np.array_equal(sums, np.array([x[order][want == z].sum(axis=0) for z in range(len(c))]))


def test_equal_centroids_are_never_pruned_by_each_other():
    low, high = np.array([[0.0, 0.0]]), np.array([[1.0, 1.0]])
    c = np.array([[0.0, 0.0], [0.0, 0.0], [5.0, 5.0], [2.0, 0.0]])
    # [2, 0] is as near as [0, 0] to the points with 1 in front
    assert clustering.dominated(low, high, c, np.ones((1, 4), bool)).tolist() == [[False, False, True, False]]


def test_against_plain_rounds_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 64).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # copies
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[4][1])]
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 63 + [None]), (2004, [0.5] * 63 + [float("nan")]), (2005, [0.5] * 63 + [float("inf")])]
    rows += [(2006, [-0.0] * 64), (2007, [1e7] * 64)]
    assert got(spark, rows) == plain(rows)


def test_few_vectors_none_and_other_parameters(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == []
    few = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-1.0] * 64)]
    assert got(spark, few) == plain(few)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 2, 3).tolist()) for i in range(150)]
    assert got(spark, rows, k=4, rounds=5, dim=3, scale=10) == plain(rows, 4, 5, 3, 10)


def test_components_that_distances_cannot_hold(spark):
    with pytest.raises(Exception, match="beyond"):
        got(spark, [(1, [1e300] * 64)])
