"""Runs of fewer lines than a window that together are a long passage."""

import pytest

from tests.llm.test_lines import brute, corpus
from wordmill.llm import lines


@pytest.mark.parametrize("seed", [1, 2])
def test_short_runs_equal_brute_force(spark, seed):
    first, second = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(20))
    texts = corpus(seed) + [f"left {i}\n{first}\n \n{second}\nright {i}" for i in range(3)] + [f"{first}\n{second[:-4]}\nend {i}" for i in range(2)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in lines.without_repeats(docs).select("row.doc_id", lines.F.col("kept").alias("text")).collect()}
    assert got == brute(rows)
    at = len(corpus(seed))
    assert got[at] == texts[at] and got[at + 1] == "left 1\n \nright 1" and got[at + 4] == texts[at + 4]
