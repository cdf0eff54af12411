import random
import re

import pytest

from wordmill.llm import lines


def brute(rows, window=3, long_words=50):
    def norm(x):
        return re.sub(r"[\t\r\x0b\f]+", " ", x).strip(" ")

    places = []
    for doc_id, text in rows:
        kept = [(i, norm(x)) for i, x in enumerate((text or "").split("\n")) if norm(x)]
        words = [len(re.split(" +", x)) for _, x in kept]
        for i in range(len(kept)):
            runs = {window} | {next((n for n in range(1, len(kept) - i + 1) if sum(words[i : i + n]) >= long_words), window)}
            for n in runs:
                part = kept[i : i + n]
                if len(part) == n:
                    places.append((tuple(x for _, x in part), doc_id, [j for j, _ in part]))
    places.sort(key=lambda p: (p[1], p[2][0]))
    seen, gone = set(), {}
    for key, doc_id, at in places:
        if key in seen:
            gone.setdefault(doc_id, set()).update(at)
        seen.add(key)
    return {d: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))) for d, t in rows}


def corpus(seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("ab cd ef gh ij".split()) for _ in range(r.randint(1, 6))) for _ in range(12)]
    long = [" ".join(r.choice("kl mn op qr".split()) for _ in range(n)) for n in (49, 50, 51, 300)]
    run = [f"common {i}" for i in range(6)]
    texts = []
    for _ in range(200):
        t = [r.choice(pool) for _ in range(r.randint(0, 12))]
        if r.random() < 0.4:
            t[len(t) // 2 : len(t) // 2] = run[r.randint(0, 2) : r.randint(3, 6)]
        if r.random() < 0.2:
            t.insert(r.randint(0, len(t)), r.choice(long))
        if r.random() < 0.3:
            t.insert(r.randint(0, len(t)), r.choice(["", "  ", "\t"]))
        texts.append("\n".join(t))
    return texts + [None, "", "\n", "same\n" * 400, "é\r\nb\r\nc", "é\nb\nc", "x" * 200000, *["hot line\nof\nall"] * 60]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = list(enumerate(corpus(seed)))
    docs = spark.createDataFrame([(d, t, d, "g") for d, t in rows], "doc_id long, text string, n_chars long, gone string").repartition(5)
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute(rows)


def test_repeated_rows_and_missing_ids(spark):
    text = "a\nb\nc\nd"
    rows = [(1, text), (1, text), (None, "x\na\nb\nc"), (0, None), (2, text + "\ne")]
    got = sorted((str(r.doc_id), r.text, r.n_deleted) for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", lines.F.col("kept").alias("text"), "n_deleted").collect() if r.doc_id != 0)
    # the row without an id comes first; equal rows are one document
    assert got == [("1", "d", 3), ("1", "d", 3), ("2", "e", 4), ("None", "x\na\nb\nc", 0)]


def test_empty(spark):
    assert lines.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
