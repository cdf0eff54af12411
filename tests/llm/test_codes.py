"""Vector codes against plain Lloyd rounds that make every sum anew."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmill.llm import codes
from wordmill.llm.shared import written


def nearest(x, entries):
    d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in entries]
    return d.index(min(d)), min(d)


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """vec_id, code, error, label_error, digest by full rounds."""
    kept = [(i, [math.floor(scale * float(v)) for v in e], label) for i, e, label in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out = []
    for dim in {len(x) for _, x, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]
        books = [[x[b:e] for _, x, _ in own[:entries]] for b, e in cut]
        for _ in range(rounds):
            for p, (b, e) in enumerate(cut):
                homes = [nearest(x[b:e], books[p])[0] for _, x, _ in own]
                for k in range(len(books[p])):
                    mine = [x[b:e] for h, (_, x, _) in zip(homes, own) if h == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        sha = hashlib.sha256(",".join(str(v) for part in books for e in part for v in e).encode()).hexdigest()
        for i, x, label in own:
            found = [nearest(x[b:e], books[p]) for p, (b, e) in enumerate(cut)]
            out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label, sha))
    total = {}
    for _, _, d, label, _ in out:
        total[label] = total.get(label, 0) + d
    return sorted(((i, c, d, total[label], sha) for i, c, d, label, sha in out), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "y") for r in rows], "vec_id long, embedding array<float>, label string, code int, error string").repartition(3)


def rounded(rows):
    return [(i, e and [None if v is None else float(np.float32(v)) for v in e], label) for i, e, label in rows]


def got(spark, rows, **more):
    found, books = codes.compress(table(spark, rows), **more)
    sha = {dim: codes.digest(b) for dim, b in books.items()}
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], sha[r["dim"]]) for r in codes.with_label_errors(found).collect()), key=repr)


def test_against_full_rounds_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 16).tolist(), "abc"[i % 3]) for i in range(250)]
    rows += [(1000 + i, rows[2][1], "a") for i in range(150)]  # copies with one label
    rows += [(7, rows[9][1], None), (7, rows[9][1], ""), (None, rows[4][1], None)]
    rows += [(2000, None, "a"), (2001, [0.5] * 15 + [None], "a"), (2002, [0.5] * 15 + [float("nan")], "a"), (2003, [0.5] * 15 + [float("-inf")], "a")]
    rows += [(2004, [], "a"), (2005, [0.5] * 3, "b"), (2006, [-0.5] * 3, "b"), (2007, [0.1] * 19, "b"), (2008, [1e4] * 16, "b")]
    assert got(spark, rows) == plain(rounded(rows))


def test_few_vectors_none_and_other_parameters(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, "a")]) == []
    few = [(2, [0.25] * 8, "a"), (1, [0.25] * 8, "a"), (3, [-1.0] * 8, None)]
    assert got(spark, few) == plain(few)
    rng = np.random.default_rng(2)
    rows = rounded([(i, rng.normal(0, 2, 6).tolist(), "ab"[i % 2]) for i in range(120)])
    assert got(spark, rows, parts=3, entries=5, rounds=40, scale=10) == plain(rows, 3, 5, 40, 10)  # rests before its last round


def test_a_round_moves_only_changed_parts(spark):
    """Contributions of a round are those of parts with a new code, and nothing else."""
    rows = [(1, [1, 2, 3, 4], b"\x00\x01", b"\x00\x01"), (2, [5, 6, 7, 8], b"\x00\x01", b"\x01\x01"), (3, [9, 10, 11, 12], b"\xff\xff", b"\x02\x00")]
    state = spark.createDataFrame(rows, "vec_id long, x array<long>, before binary, code binary")
    found = {tuple(r)[:4]: int(r["value"]) for r in codes.deltas(state, 3, 2).collect() if r["value"]}
    assert found == {
        (4, 0, 1, -1): 1, (4, 0, 1, 0): 5, (4, 0, 1, 1): 6, (4, 0, 0, -1): -1, (4, 0, 0, 0): -5, (4, 0, 0, 1): -6,
        (4, 0, 2, -1): 1, (4, 0, 2, 0): 9, (4, 0, 2, 1): 10, (4, 1, 0, -1): 1, (4, 1, 0, 0): 11, (4, 1, 0, 1): 12,
    }


def test_decoded_vectors_have_the_error_that_is_told(spark):
    rng = np.random.default_rng(3)
    rows = rounded([(i, rng.normal(0, 1, 16).tolist(), "a") for i in range(100)])
    found, books = codes.compress(table(spark, rows))
    back = {r["vec_id"]: [round(4096 * v) for v in r["embedding"]] for r in codes.decoded(found, books).collect()}
    told = {r["vec_id"]: r["error"] for r in found.collect()}
    assert {i: sum((a - math.floor(4096 * b)) ** 2 for a, b in zip(back[i], e)) for i, e, _ in rows} == told


def test_one_label_with_most_rows(spark):
    found = written(spark, spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") > 50, "x").alias("label"), F.lit(1).alias("error")), "c")
    assert {tuple(r) for r in codes.with_label_errors(found).select("label", "label_error").distinct().collect()} == {("x", 2949), (None, 51)}


def test_too_large_and_too_many_lengths(spark):
    with pytest.raises(Exception, match="beyond"):
        got(spark, [(1, [1e30] * 8, "a")])
    with pytest.raises(ValueError, match="different numbers"):
        got(spark, [(i, [0.0] * i, "a") for i in range(70)])
