import re

import pytest
from pyspark.sql import functions as F

from wordmill.llm import mixing


def brute_targets(sizes):
    """sizes: [(source or None, size)]; the rule, step by step."""
    names = sorted({s for s, _ in sizes}, key=lambda s: (s is None, (s or "").encode()))
    total = {n: sum(x for s, x in sizes if s == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    pool, free, got = 1.5 * sum(total.values()), set(names), {}
    while free:
        w = sum(weight[n] for n in free)
        over = {n for n in free if pool * weight[n] / w >= 2 * total[n]}
        if not over:
            return got | {n: pool * weight[n] / w for n in free}
        for n in over:
            got[n] = 2.0 * total[n]
        pool -= sum(2 * total[n] for n in over)
        free -= over
    return got


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [(i, " ".join(["w"] * (i * 7919 % 400)), f"s{i % 5}" if i % 3 else "hot", 1) for i in range(3000)]
    rows += [(9000 + i, None if i % 2 else "\t \n", None, 1) for i in range(4)] + [(9100 + i, "a\x0bb c d", None, 1) for i in range(50)]
    rows += [(5, "twice the same", "s1", 1)] * 2 + [(None, "no id", "zz", 1)] + [(9500 + i, "x " * 5, "é", 1) for i in range(40)]
    d = str(tmp_path_factory.mktemp("mix"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, size long").write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_whole_result(spark, table):
    d, rows = table
    got = mixing.op6_mixing(spark, d).collect()
    sizes = [(r[2], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), s) for r, (_, s) in zip(rows, sizes))
    want = brute_targets(sizes)
    for source, target in want.items():
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {sum(s for n, s in sizes if n == source)}
        assert all(abs(r.target - target) <= 1e-9 * max(1, target) for r in own)
        if len(own) > 10:
            assert abs(sum(r.taken for r in own) - target) <= max(0.02 * target, 10), source
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = mixing.op6_mixing(spark, d).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rows_of_the_mix(spark, table):
    d, _ = table
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("copies", F.lit("clash"))
    out = mixing.mix_rows(docs)
    assert out.columns == docs.columns and {r.copies for r in out.select("copies").distinct().collect()} == {"clash"}
    assert out.count() == mixing.mixed(docs).agg(F.sum("copies")).first()[0]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op6_mixing(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name(spark, table):
    d, _ = table
    names = ["target", "whole", "of", "bits", "row", "copies", "source_size", "part", "rate", "bin"]
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({n: F.lit("clash") for n in names})
    out = mixing.mixed(docs)
    assert sorted(out.columns) == sorted(set(docs.columns) | set(mixing.ADDED)) and dict(out.dtypes)["target"] == "double"
    assert out.agg(F.sum("copies")).first()[0] == mixing.mixed(docs.select("doc_id", "text", "source")).agg(F.sum("copies")).first()[0]


def test_many_sources_and_a_very_long_text(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 2000}", 0) for i in range(6000)] + [(9000, "w " * 300_000, "s5", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(9)
    got = {r.source: r.target for r in mixing.mixed(docs).select("source", "target").distinct().collect()}
    want = brute_targets([(s, len(t.split())) for _, t, s, _ in rows])
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_newton_reaches_every_target(spark):
    goals = spark.createDataFrame([("a", 100, 200.0), ("b", 1000, 1.0), ("c", 0, 0.0), ("d", 7, 7.0)], "source string, source_size long, target double")
    got = {r.source: r.rate for r in mixing.multipliers(goals).collect()}
    assert abs(got["a"] - 2) < 1e-9 and abs(got["b"] - 0.001) < 1e-9 and got["c"] == 1 and abs(got["d"] - 1) < 1e-9
