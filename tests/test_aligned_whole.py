"""Listings of edits leave nothing out: long segments and lines that moved far are compared as short ones are."""

import random

import pytest

from wordmill.operators import aligned
from wordmill.plans import documents

from .test_aligned import tables


def longest(old, new):
    row = [0] * (len(new) + 1)
    for x in old:
        before = row[:]
        for j, y in enumerate(new):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def listed(spark, old, new, size=1 << 16, **limits):
    """How many edits there are; they lead from one side to the other."""
    rows = aligned.edits(*tables(spark, old, new), size, **limits).collect()
    gone, come = ({r["rank"]: r["line"] for r in rows if r["side"] == side} for side in ("<<", ">>"))
    assert all(old[i] == x for i, x in gone.items()) and all(new[i] == x for i, x in come.items())
    assert [x for i, x in enumerate(old) if i not in gone] == [x for i, x in enumerate(new) if i not in come]
    assert len(rows) == len(gone) + len(come)
    return len(rows)


def test_common_in_halves():
    rnd = random.Random(2)
    for _ in range(300):
        old, new = ([rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        for most in (0, 7, 1 << 20):
            at = aligned.common(old, new, most)
            assert all(old[i] == new[j] for i, j in at) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(at, at[1:]))
            assert len(at) == longest(old, new)


def test_heaviest_rising():
    rnd = random.Random(3)
    for _ in range(200):
        x = rnd.sample(range(30), rnd.randint(0, 8))
        w = [rnd.randint(1, 5) for _ in x]
        found = aligned.heaviest_rising(x, w)
        chosen = [[i for i in range(len(x)) if m >> i & 1] for m in range(1 << len(x))]
        best = max(sum(w[i] for i in own) for own in chosen if [x[i] for i in own] == sorted(x[i] for i in own))
        assert [x[i] for i in found] == sorted(x[i] for i in found) and sum(w[i] for i in found) == best


@pytest.mark.parametrize("sides", [(40, 40), (9, 50), (50, 9), (3, 3)])
def test_blocks_find_a_shortest_listing(spark, sides):
    rnd = random.Random(sum(sides))
    old, new = ([rnd.choice("abcx") for _ in range(n)] for n in sides)
    assert listed(spark, old, new, 4, pairs=1, block=5) == len(old) + len(new) - 2 * longest(old, new)


def test_blocks_of_several_segments(spark):
    rnd = random.Random(8)
    parts = [([rnd.choice("ab") for _ in range(n)], [rnd.choice("ab") for _ in range(m)]) for n, m in [(30, 20), (2, 2), (6, 31), (0, 4)]]
    old, new = ([x for k, part in enumerate(parts) for x in [f"anchor {k}", *part[i]]] for i in (0, 1))
    assert listed(spark, old, new, 4, pairs=3, block=4) == sum(len(a) + len(b) - 2 * longest(a, b) for a, b in parts)


def test_lines_that_all_stand_in_order(spark):
    """Lines only gone, lines only come, and both in a third segment, which the walk must leave to the comparison."""
    rnd = random.Random(10)
    full = [[rnd.choice("abc") for _ in range(n)] for n in (40, 33, 30)]
    part = [[x for x in own if rnd.random() > 0.3] for own in full]
    parts = [(full[0], part[0]), (part[1], full[1]), (part[2], part[2][::-1]), (["a", *full[0]], [*full[0][::-1], "b", "a"])]
    old, new = ([x for k, own in enumerate(parts) for x in [f"anchor {k}", *own[i]]] for i in (0, 1))
    assert listed(spark, old, new, 4, pairs=3, block=6) == sum(len(a) + len(b) - 2 * longest(a, b) for a, b in parts)


def test_a_segment_of_many_pairs_is_compared(spark):
    rnd = random.Random(9)
    old = ["p", *(rnd.choice("xy") for _ in range(1700)), "q"]
    new = ["P", *(x for x in old[1:-1] if rnd.random() > 0.1), "Q"]  # 1.3 million pairs of equal lines
    assert listed(spark, old, new) == len(old) + len(new) - 2 * longest(old, new)


def test_a_block_that_moved_over_many_ranges(spark):
    lines = [f"line {i}" for i in range(60)]
    moved = lines[7:50] + lines[:7] + lines[50:]
    assert aligned.anchors(*map(aligned.ranked, tables(spark, lines, moved)), 4).count() == 53
    assert listed(spark, lines, moved, 4) == 14
    mixed = lines[:]
    random.Random(4).shuffle(mixed)
    assert listed(spark, lines, mixed, 4) == 120 - 2 * longest(lines, mixed)


def test_dump_edits_of_many_copies_is_what_its_sql_counts(spark, tmp_path):
    import duckdb

    rows = [(c, t, f"said {(c * 7 + t * t) % 3}") for c in range(900) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"create or replace temp view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    import __spark_entry__

    told = duckdb.sql(__spark_entry__.oracle_sql()["dump_edits"]).fetchall()
    assert sorted(map(tuple, documents.dump_edits(spark, str(tmp_path)).collect())) == sorted(told)


def test_rows_of_one_place_keep_one_order(spark, tmp_path):
    rows = [(1, t, f"{x} {t}") for t in range(40) for x in "ab"]
    spark.createDataFrame(random.Random(6).sample(rows, 80), "conv_id long, turn int, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    old, new = documents.snapshots(spark, str(tmp_path))
    gone = [r for r in aligned.edits(old, new, 4).collect()]
    assert {r["side"] for r in gone} == {"<<"} and all((1 + int(r["line"][2:])) % 7 == 3 for r in gone) and len(gone) == 12
