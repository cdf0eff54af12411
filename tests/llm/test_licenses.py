import random
import re

from wordmill.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, threshold=0.8):
    w = words(text)
    base = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    labels = {x for _, x in base}
    best = 0.0
    for line in (text or "").split("\n"):
        bag = set(words(line))
        for label, t in licenses.TEMPLATES.items():
            own = set(words(t))
            if len(bag & own) >= threshold * len(own) - 1e-9:
                labels.add(label)
                best = max(best, len(bag & own) / len(own))
    at = [i for i, _ in base]
    return (len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else best)


def test_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    texts = [None, "", "MIT  License", "mit\nlicense MIT-license, mit licenses", "éMIT License; MIT License é", "the Apache\x00License general public_license General-Public  LICENSE", "İMIT license", "w " * 50000 + "mit license", "lİcense mit lıcense", "\n" * 2000]
    pool = [*licenses.TEMPLATES.values()]
    for _ in range(300):
        t = r.choice(pool).split()
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = r.choice(["zu", "the", "license", "of"])
        if r.random() < 0.5:
            t += ["and", "more"]
        texts.append("\n".join(r.choice(["", "der die das", " ".join(t), " ".join(t).upper()]) for _ in range(r.randrange(1, 4))))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (3, "All rights reserved.", 1), (None, "MIT License", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_words long").write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op10_licenses(spark, str(tmp_path)).collect()
    pack = lambda d, x: str((d, *x))
    assert sorted(pack(x[0], x[1:]) for x in got) == sorted(pack(d, brute(t)) for d, t, _ in rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert licenses.op10_licenses(spark, str(tmp_path)).count() == 0
