"""Predictions against the same contests in plain Python."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np

from wordmill.llm import langid

M = 0xFFFFFFFF


def plain_trigrams(text):
    points = [ord(c) if c.isalpha() else 32 for c in f"{text.lower()}  "]
    points = [32, *points, 32]
    out = []
    for i in range(1, len(points) - 1):
        if points[i] != 32:
            h = (points[i - 1] * 0x9E3779B1 & M) ^ ((points[i] * 0x85EBCA6B + 0x27D4EB2F) & M) ^ (points[i + 1] * 0xC2B2AE35 & M)
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D & M) >> (32 - langid.BITS))
    return out


def plain_prediction(text, model):
    found = plain_trigrams(text or "")
    if not found:
        return "und", 0.0
    counts = Counter(found)
    margins = {c: sum(n * float(model["w"][f, k]) for f, n in counts.items()) * 20 / len(found) + float(model["b"][k]) for k, c in enumerate(model["contests"])}

    def winner(level, names):
        if len(names) == 1:
            return names[0], math.inf
        total, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, math.inf)
        for a, b in combinations(names, 2):
            x = margins[(level, a, b)]
            for name, y in ((a, x), (b, -x)):
                total[name] += max(-1.0, min(1.0, y))
                least[name] = min(least[name], y)
        best = max(names, key=lambda n: total[n])
        return best, least[best]

    kin, sure = winner("family", model["families"])
    lang, inner = winner("language", [n for n in model["names"] if langid.family(n) == kin])
    return lang, 1 / (1 + math.exp(-2 * max(-20.0, min(20.0, min(sure, inner)))))


def corpus():
    r = random.Random(4)
    letters = {"en": "thewandofi", "de": "dieünderß", "fr": "lesçéaton", "es": "quelañosí", "xx": "ωκλμαζ"}
    word = lambda lang: "".join(r.choice(letters[lang]) for _ in range(r.randint(1, 7)))
    rows = [(lang, " ".join(word(lang) for _ in range(r.randrange(5, 60)))) for lang in letters for _ in range(40)]
    r.shuffle(rows)
    return [(i, t, lang) for i, (lang, t) in enumerate(rows)]


def test_predictions_equal_plain_contests(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fitted(docs)
    odd = [(1000, None), (1001, ""), (1002, "12 3"), (1003, "ÜBER Häuser"), (1004, "a"), (1005, "the " * 40000)]
    every = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(every, model).collect()}
    for i, t in [(i, t) for i, t, _ in rows] + odd:
        lang, score = plain_prediction(t, model)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4
    assert sum(got[i][0] == lang for i, _, lang in rows) >= 0.95 * len(rows)


def test_machine_reaches_the_least_loss():
    """No small step in any direction lowers what the machine minimises."""
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 4)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * r.normal(size=60) > 0, 1, -1).astype(np.float32)
    w, c = langid.machine(x, y, passes=3000)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w, c):
        return float((weight * np.maximum(0, 1 - y * (x @ w + c)) ** 2).sum() + langid.NORM * (w * w).sum())

    least = loss(w.astype(np.float64), c)
    for d in r.normal(size=(200, 5)):
        d = d / np.linalg.norm(d) * 0.05
        assert loss(w + d[:-1], c + d[-1]) >= least - 1e-6
