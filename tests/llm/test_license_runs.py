"""License notices and bodies that are wrapped over several lines."""

import math
import random
import textwrap

from tests.llm.test_licenses import words
from wordmill.llm import licenses

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
GPL = "This work is licensed under the GNU\nGeneral Public License, version 3"


def brute(text, threshold=0.8):
    """{label: containment} by all lines and all runs of words."""
    w = words(text)
    found = {}
    for label, t in licenses.TEMPLATES.items():
        own = set(words(t))
        run = math.ceil(len(words(t)) / threshold - 1e-9)
        bags = [set(words(line)) for line in text.split("\n")] + [set(w[i : i + run]) for i in range(len(w))]
        best = max((len(b & own) for b in bags), default=0)
        if best >= threshold * len(own) - 1e-9:
            found[label] = best / len(own)
    return found


def wrapped(r, t):
    sign = r.choice(["", "# ", " * ", "// "])
    return "\n".join(sign + x for x in textwrap.wrap(t, r.choice([20, 40, 72])))


def test_equals_brute_force(spark):
    r = random.Random(7)
    texts = [BSD, GPL, "", "all\n" + "x " * 9 + "rights\nreserved", "all\nrights\nreserved", "All rights\n\nreserved", "x\n" * 3000 + BSD + "\nx" * 3000]
    texts += [wrapped(r, t) for t in licenses.TEMPLATES.values()]
    pool = [w for t in licenses.TEMPLATES.values() for w in words(t)]
    for _ in range(150):
        t = r.choice([*licenses.TEMPLATES.values()]).split()
        for _ in range(r.randrange(1 + len(t) // 2)):
            t[r.randrange(len(t))] = r.choice(pool)
        if r.random() < 0.4:
            at = r.randrange(len(t))
            t[at:at] = ["zu"] * r.randrange(1 + len(t) // 3)
        more = [r.choice(pool) for _ in range(r.randrange(60))]
        texts.append(wrapped(r, " ".join(more + t + more[::-1])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: {b.label: b.containment for b in x.blocks} for x in licenses.scanned(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert got[0] == {"notice-bsd": 1.0} and "notice-gpl-3.0" in got[1] and not got[3]
    assert all(label in got[7 + i] for i, label in enumerate(licenses.TEMPLATES))


def test_query_finds_wrapped_notices(spark, tmp_path):
    mit = "# " + "\n# ".join(textwrap.wrap(licenses.TEMPLATES["license-mit"], 60))
    rows = [(1, f"a\n{BSD}\nb"), (2, f"a\n\n{mit}\nb"), (3, GPL)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.labels, x.score) for x in licenses.op10_licenses(spark, str(tmp_path)).collect()}
    assert got == {1: ("notice-bsd", 1.0), 2: ("license-mit", 1.0), 3: ("gpl,notice-gpl-3.0", 1.0)}
