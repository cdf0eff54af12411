"""Edits between two lists of lines: they lead from one to the other, and are no more than needed where nothing moved."""

import difflib
import random

import pytest

from wordmill.operators import aligned


def tables(spark, old, new):
    make = lambda lines: spark.createDataFrame([(10 * i + 3, x) for i, x in enumerate(lines)], "place long, line string").repartition(3)
    return make(old), make(new)


def got(spark, old, new, size):
    rows = sorted(tuple(r) for r in aligned.edits(*tables(spark, old, new), size).collect())
    gone, come = ({rank: line for _, s, rank, line in rows if s == side} for side in ("<<", ">>"))
    assert all(old[i] == x for i, x in gone.items()) and all(new[i] == x for i, x in come.items())
    assert [x for i, x in enumerate(old) if i not in gone] == [x for i, x in enumerate(new) if i not in come]
    return rows


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_edits_lead_from_old_to_new(spark, size):
    rnd = random.Random(size)
    base = [rnd.choice(["", "a", "b", f"line {i}"]) for i in range(60)]
    changed = list(base)
    for _ in range(8):
        i = rnd.randrange(len(changed))
        changed[i : i + rnd.randint(0, 2)] = [f"new {rnd.random()}"] * rnd.randint(0, 2)
    moved = base[30:] + base[:30]
    for new in (changed, moved, base[::-1]):
        got(spark, base, new, size)


def test_no_more_edits_than_a_plain_comparison_has(spark):
    old = ["start", "", "one", "", "two", "three", "", "four", "end"]
    new = ["start", "", "one", "", "TWO", "three", "", "", "four", "end"]
    rows = got(spark, old, new, 4)
    assert [(s, line) for _, s, _, line in rows] == [("<<", "two"), (">>", "TWO"), (">>", "")]
    plain = [x for x in difflib.ndiff(old, new) if x[0] in "+-"]
    assert len(rows) == len(plain)


def test_equal_and_empty_sides(spark):
    lines = ["a", "a", "b", ""]
    assert got(spark, lines, lines, 4) == []
    assert [(s, x) for _, s, _, x in got(spark, [], lines, 4)] == [(">>", x) for x in lines]
    assert [(s, x) for _, s, _, x in got(spark, lines, [], 4)] == [("<<", x) for x in lines]
    assert got(spark, [], [], 4) == []


def test_longest_rising():
    rnd = random.Random(1)
    for _ in range(200):
        x = rnd.sample(range(30), rnd.randint(0, 8))
        found = [x[i] for i in aligned.longest_rising(x)]
        best = max((len(s) for m in range(1 << len(x)) if (s := [v for i, v in enumerate(x) if m >> i & 1]) == sorted(s)), default=0)
        assert found == sorted(found) and len(found) == best


def test_repeated_lines_of_a_segment_stay(spark):
    old = ["start", "p", "x", "q", "x", "r", "end"]
    new = ["start", "P", "x", "x", "R", "end"]
    assert [(s, line) for _, s, _, line in got(spark, old, new, 4)] == [("<<", "p"), ("<<", "q"), ("<<", "r"), (">>", "P"), (">>", "R")]
    assert len(aligned.edits(*tables(spark, old, new), 4, most=1).collect()) == 9  # too many pairs for a task: a longer listing


def test_repeated_lines_have_a_shortest_listing(spark):
    rnd = random.Random(5)
    old = [rnd.choice("abc") for _ in range(40)]
    new = ["z" if rnd.random() < 0.2 else x for x in old if rnd.random() > 0.3]
    row = [0] * (len(new) + 1)
    for x in old:
        before = row[:]
        for j, y in enumerate(new):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    assert len(got(spark, old, new, 1 << 16)) == len(old) + len(new) - 2 * row[-1]


def test_long_conversations_keep_their_order(spark, tmp_path):
    """A turn beyond 1,000 is no turn of the next conversation."""
    from wordmill.plans import documents

    rows = [(1, t, f"one {t}") for t in range(995, 1010)] + [(2, t, f"two {t}") for t in range(10)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    old, _ = documents.snapshots(spark, str(tmp_path))
    assert [r["line"] for r in aligned.ranked(old).orderBy("rank").collect()] == [x for _, _, x in rows]
