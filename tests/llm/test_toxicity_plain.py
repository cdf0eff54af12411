"""Scores and training against the same sums in plain Python."""

import math
import random
import re

import numpy as np

from wordmill.llm import blocks, toxicity

WORD = re.compile(rb"[a-z0-9'\x80-\xff]+")


def feature(word, kind):
    data = np.frombuffer(word, np.uint8)
    h = blocks.slice_hashes(data, np.array([0]), np.array([len(word)]))
    return int(blocks.mix(h + np.uint64(kind))[0]) & ((1 << toxicity.BITS) - 1)


def plain_sentences(text):
    """Features of every sentence that has words, as lists."""
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    out = []
    for part in re.split(rb"[.!?\n]", low):
        words = WORD.findall(part)
        if words:
            own = [feature(w, 0) for w in words]
            for kind, n in enumerate(toxicity.BEGINNINGS, 1):
                own += [feature(w[:n], kind) for w in words if len(w) > n]
            out.append(own)
    return out


def plain_score(text, w):
    keep = 1.0
    for s in plain_sentences(text):
        z = sum(float(w[f]) for f in s) + float(w[-1])
        keep *= 1 - 1 / (1 + math.exp(-z))
    return 1 - keep


def corpus():
    r = random.Random(2)
    words = [f"wort{i}" for i in range(30)] + ["Église", "it's", "über", "a"]
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 7)))
    return ["".join(sentence() + r.choice([". ", "! ", "?", "\n", " . . "]) for _ in range(r.randrange(0, 6))) for _ in range(80)] + [None, "", "...", "one"]


def test_scores_equal_plain_sums(spark):
    texts = corpus()
    w = np.random.default_rng(1).normal(0, 0.4, (1 << toxicity.BITS) + 1).astype(np.float32)
    w[-1] = -1.5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, w).collect()}
    assert all(abs(got[i] - plain_score(t, w)) < 1e-9 for i, t in enumerate(texts))


def test_training_equals_plain_loops():
    r = random.Random(3)
    texts, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        own = [" ".join(r.choice("ab cd ef gh ij kl mn".split()) for _ in range(4)) for _ in range(3)]
        if bad:
            own[r.randrange(3)] += " vile" if i % 8 else " foul"
        texts.append(". ".join(own).encode())
        labels.append(float(bad))
    labels = np.array(labels)
    f, s, o = toxicity.sentences(texts)
    seen, toxic = toxicity.in_documents(f, s, o, labels)
    passes = 25
    got = toxicity.train(f, s, o, labels, seen, toxic, passes)

    bags = [[sorted(set(x)) for x in plain_sentences(t.decode())] for t in texts]
    in_docs = {}
    for d, own in enumerate(bags):
        for x in {x for b in own for x in b}:
            n, t = in_docs.get(x, (0, 0.0))
            in_docs[x] = n + 1, t + labels[d]
    rate = labels.mean()
    used = sorted(x for x, (n, t) in in_docs.items() if t >= toxicity.LEAST and t - n * rate >= toxicity.FAR * math.sqrt(n * rate * (1 - rate)))
    assert used and all(in_docs[x] == (seen[x], toxic[x]) for x in in_docs)
    w = dict.fromkeys(used, 0.0) | {"c": toxicity.START}
    m, v = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0)
    for t in range(1, passes + 1):
        g = dict.fromkeys(w, 0.0)
        for own, label in zip(bags, labels):
            zs = [sum(w[x] for x in b if x in w) + w["c"] for b in own]
            total = sum(math.log1p(math.exp(z)) for z in zs)
            outer = -math.exp(-total) / max(1 - math.exp(-total), 1e-9) if label else 1.0
            for b, z in zip(own, zs):
                slope = outer / (1 + math.exp(-z)) / len(bags)
                for x in [*(x for x in b if x in w), "c"]:
                    g[x] += slope
        for x in w:
            m[x], v[x] = 0.9 * m[x] + 0.1 * g[x], 0.999 * v[x] + 0.001 * g[x] ** 2
            w[x] -= 0.3 * (m[x] / (1 - 0.9**t)) / (math.sqrt(v[x] / (1 - 0.999**t)) + 1e-6)
            if x != "c":
                w[x] = math.copysign(max(abs(w[x]) - toxicity.SHRINK, 0), w[x])
    assert set(np.flatnonzero(got[:-1]).tolist()) <= set(used)
    assert all(abs(float(got[x]) - w[x]) < 1e-4 for x in used) and abs(float(got[-1]) - w["c"]) < 1e-4


def test_several_labels_of_a_document(spark):
    rows = [(i, "calm day. " + ("such vile talk" if i % 4 == 0 else "fine talk")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    twice = spark.createDataFrame(labels + [(i, 0) for i in range(0, 400, 4)] + [(None, 1)], "doc_id long, toxic int")
    once = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert np.array_equal(toxicity.fitted(docs, twice), toxicity.fitted(docs, once))
