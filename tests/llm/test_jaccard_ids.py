"""Rows that share a doc_id but not a text."""

import random

from tests.llm.test_jaccard import brute
from wordmill.llm import jaccard


def by_row(rows):
    """Groups of rows, each by its own text, tied by doc_id: {row: (size, smallest doc_id)}."""
    single = brute([(i, t) for i, (_, t) in enumerate(rows)])
    up = {("d", d): ("d", d) for d, _ in rows} | {("g", g): ("g", g) for _, g in single.values()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, _) in enumerate(rows):
        up[root(("g", single[i][1]))] = root(("d", d))
    least = {}
    for d, _ in rows:
        least[root(("d", d))] = min(d, least.get(root(("d", d)), d))
    return [(d, single[i][0], least[root(("d", d))]) for i, (d, _) in enumerate(rows)]


def test_every_text_of_an_id_is_compared(spark):
    r = random.Random(3)
    rows = []
    for g in range(25):
        other, shared = ([f"{c}{g}x{i}" for i in range(60)] for c in "os")
        near = shared[:-1] + ["end"]
        # id 1000 + g stands for the class of both texts; the other ids are similar to one of them only
        rows += [(1000 + g, " ".join(other)), (1000 + g, " ".join(shared)), (2000 + g, " ".join(shared)), (3000 + g, " ".join(near)), (4000 + g, " ".join(other[1:]))]
    rows += [(1000, rows[6][1]), (7, ""), (7, "a b c d e f"), (8, "a b c d e f"), (9, ""), (8, "a b c d e f")]
    r.shuffle(rows)
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(6)
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.groups(docs).collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted(by_row(rows))
    assert [x for x in got if x[0] is None] == [(None, brute(rows[:1])[rows[0][0]][0], None)]
