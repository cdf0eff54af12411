import math
import random

import numpy as np
import pytest

from wordmill.llm import neardup

NAN = float("nan")


def brute(rows, threshold=0.98):
    v = {}
    for i, e, label in rows:
        if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v[i] = min(v.get(i, (label, e)), (label, e))
    ids = sorted(v)
    links = {i: set() for i, *_ in rows if i is not None}
    x = {i: np.array(np.float32(v[i][1]), np.float64) for i in ids}
    for a in ids:
        for b in ids:
            if a < b and v[a][0] == v[b][0] and len(x[a]) == len(x[b]) and x[a] @ x[b] / math.sqrt(x[a] @ x[a]) / math.sqrt(x[b] @ x[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in sorted(links):
        todo = [i] if i not in comp else []
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = i
                todo += links[j]
    return sorted((str(i), len(links.get(i, ())), str(comp.get(i)), comp.get(i) == i if i is not None else True) for i, *_ in rows)


@pytest.mark.parametrize("n,block,pivots", [(600, 4096, 8), (500, 16, 3), (0, 8, 4)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, n, block, pivots):
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(n)
    centres = [[r.gauss(0, 1) for _ in range(5)] for _ in range(9)]
    rows = []
    for i in range(n):
        c, spread = r.choice(centres), r.choice([0, 0.02, 0.15, 0.4])
        rows.append((i, [float(np.float32(x + spread * r.gauss(0, 1))) for x in c], r.choice([1, 1, 2])))
    if n:
        e = rows[0][1]
        rows += [(None, e, 1), (1000, None, 1), (1001, [], 1), (1002, [0.0] * 5, 1), (1003, [NAN, *e[1:]], 1), (1004, [None, *e[1:]], 1), (1005, e, None), (1006, e[:3], 1), (0, e, rows[0][2]), (0, e, rows[0][2])]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "vec_id long, embedding array<float>, label int, n_links int")
    docs.write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(neardup, "PIVOTS", (pivots,))
    got = neardup.op7_neardup(spark, str(tmp_path)).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in got) == brute(rows)


def test_pivots_by_size_and_clusters():
    r = np.random.default_rng(1)
    centres = neardup._unit(r.normal(size=(64, 8)))
    clustered = neardup._unit(centres[r.integers(0, 64, 3000)] + 0.02 * r.normal(size=(3000, 8)))
    few, many = (len(neardup.chosen_pivots(clustered, n, 0.2)) for n in (1000, 10**8))
    assert few < many and len(neardup.chosen_pivots(clustered[:3], 3, 0.2)) == 3


@pytest.mark.parametrize("kind", ["double", "float"])
def test_links_at_the_threshold_and_other_types(spark, kind):
    # two vectors at an angle whose cosine is the threshold but for the last digits, on both sides of a border
    rows = [(i, [math.cos(a), math.sin(a)], "x") for i, a in enumerate([0.0, math.acos(0.98) * (1 - 1e-12), 3.0, 3.0])]
    docs = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string")
    got = {x.vec_id: (x.n_links, x.component_id) for x in neardup.near_duplicates(docs, numbers=(4,)).collect()}
    x = [np.array(e, np.float32 if kind == "float" else np.float64).astype(np.float64) for _, e, _ in rows]
    linked = x[0] @ x[1] / math.sqrt(x[0] @ x[0]) / math.sqrt(x[1] @ x[1]) >= 0.98
    assert got == {0: (int(linked), 0), 1: (int(linked), 0 if linked else 1), 2: (1, 2), 3: (1, 2)}
