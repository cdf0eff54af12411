import math
import random

import pytest

from wordmill.llm import topk

NAN, INF = float("nan"), float("inf")


def brute(rows, k=5):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            x = [math.floor(256 * x) for x in e]
            v[i] = min(v.get(i, x), x)
    out = []
    for q in v:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("n,block", [(700, 64), (900, 4096), (4, 4096), (0, 8)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, n, block):
    monkeypatch.setattr(topk, "VECTORS", block)
    monkeypatch.setattr(topk, "QUERIES", 5)
    r = random.Random(n)
    one = [0.5] * 6
    rows = [(i, one if r.random() < 0.2 else [r.randrange(-64, 64) / 256 for _ in range(6)]) for i in range(n)]
    if n > 100:
        rows += [(None, one), (1000, None), (1050, [NAN] * 6), (1100, [INF] + one[1:]), (1150, [None] + one[1:]), (1200, []), (1250, [1.0]), (1300, [2.0]), (50, [9.0] * 6), (7, one), (7, one), (1350, [-0.001] * 6)]
    spark.createDataFrame([(*x, "s") for x in rows], "vec_id long, embedding array<float>, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk.op1_topk(spark, str(tmp_path)).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute(rows)
