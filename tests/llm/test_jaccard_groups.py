"""A large group of near copies: found whole, by few links."""

import random

import numpy as np
import pyarrow as pa

from tests.llm.test_jaccard import brute
from wordmill.llm import jaccard


def test_large_group_with_outsiders(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(500):  # near copies of one text, half of them by too many changes for a link with the text itself
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            t[r.randrange(len(t))] = f"x{r.randrange(40)}"
        texts.append(t)
    rows = list(enumerate(" ".join(t) for t in texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.groups(docs).collect()}
    assert got == brute(rows)


def test_links_of_a_block_are_a_forest():
    r = random.Random(1)
    base = sorted(r.sample(range(10**6), 100))
    sets = [np.array(sorted({*base[i % 5 :], 10**6 + i}), np.uint64) for i in range(60)]
    table = lambda at: pa.table({"doc_id": at, "n": [len(sets[i]) for i in at], "bits": [jaccard.bitmap(sets[i]) for i in at], "component_id": at, "hashes": [sets[i].tobytes() for i in at]})
    links = jaccard.spanning(table(list(range(20))), table(list(range(20, 60))), 80, 100).to_pylist()
    assert len(links) == 59
    seen = {0}
    for _ in range(60):
        for x in links:
            if seen & {x["a"], x["b"]}:
                seen |= {x["a"], x["b"]}
    assert seen == set(range(60))
