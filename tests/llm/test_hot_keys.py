"""One group of copies, and one id with very many links, among other rows."""

import pytest
from pyspark.sql import functions as F

from wordmill.llm import jaccard, neardup
from wordmill.llm.shared import components

COPIES = 50_000


@pytest.mark.parametrize("hub", [0, 70_000])
def test_components_of_a_hub(spark, hub):
    """A hub with the smallest and with the largest number, and a chain."""
    leaves = spark.range(1, 30_000).select(F.lit(hub).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(100_000, 100_060).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(spark, leaves.union(chain))
    got = {(r["component_id"], r["n"]) for r in found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(min(hub, 1), 30_000), (100_000, 61)}


def test_many_equal_vectors(spark):
    copies = spark.range(COPIES).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"), F.lit("x").alias("label"))
    others = spark.createDataFrame([(COPIES, [1.0, 0.51], "x"), (COPIES + 1, [1.0, 0.5], "y"), (COPIES + 2, [-1.0, 0.5], "x")], "vec_id long, embedding array<double>, label string")
    got = neardup.near_duplicates(copies.union(others))
    assert {tuple(r) for r in got.groupBy("n_links", "component_id").count().collect()} == {(COPIES, 0, COPIES + 1), (0, COPIES + 1, 1), (0, COPIES + 2, 1)}


def test_many_equal_texts(spark):
    copies = spark.range(COPIES).select(F.col("id").alias("doc_id"), F.lit("one two three four five six seven eight nine ten eleven").alias("text"))
    others = spark.createDataFrame([(COPIES, "one two three four five six seven eight nine ten"), (COPIES + 1, "of its own")], "doc_id long, text string")
    got = jaccard.groups(copies.union(others))
    assert {tuple(r) for r in got.groupBy("n_shingles", "component_id").count().collect()} == {(7, 0, COPIES), (6, 0, 1), (1, COPIES + 1, 1)}
