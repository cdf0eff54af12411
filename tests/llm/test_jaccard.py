import random
import re

import pytest

from wordmill.llm import jaccard


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        t = [word() for _ in range(r.choice([0, 1, 3, 4, 5, 6, 9, 12, 30, 80, 200]))]
        if r.random() < 0.3:
            t[len(t) // 2 : len(t) // 2] = passage
        texts.append(t)
        for _ in range(r.choice([0, 0, 1, 3])):
            u = list(t)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if u:
                    u[r.randrange(len(u))] = word()
            if r.random() < 0.5:
                u += [word() for _ in range(r.randrange(1 + len(u) // 4))]
            texts.append(u)
    base = [word() for _ in range(120)]
    for i in range(80):  # a large group of near copies that drifts
        base[r.randrange(120)] = word()
        texts.append(list(base))
    texts = [r.choice([" ", "\n", " \t"]).join(t) for t in texts]
    texts += [texts[0].upper().replace("É", "é")] * 5 + [None, "", " \x0b\n ", "x" * 300000, "w " * 60000]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,hot,least,small", [(1, 1 << 18, 16, 64), (2, 1 << 18, 2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, least, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 8 * small)
    monkeypatch.setattr(jaccard, "HOT_LEAST", least)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "s", 5) for d, t in rows], "doc_id long, text string, component_id string, n long").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs, hot=hot).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f")] * 3 + [(2, "A B C D E F"), (None, "a b c d e f"), (4, None)]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [*[(1, 2, 1)] * 3, (2, 2, 1), (None, 2, None), (4, 0, 4)])) or sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("1", 2, "1")] * 3 + [("2", 2, "1"), ("None", 2, "None"), ("4", 0, "4")])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.groups(docs).count() == 0


def test_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "zz", 3), (None, "a b c d e f", 4)]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert out.columns == ["doc_id", "text", "n_chars"] and {r.doc_id for r in out.collect()} == {1, 2, None}
