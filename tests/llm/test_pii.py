import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wordmill.llm import pii

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(d) <= 19 and luhn(d),
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None,
    "",
    "a@b.c_x@d.e a@b.c.@x.y é😀 joe.x+1@mail.example.com, x@y",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 9.9.9.9.",
    "4539 1488 0343 6467 and 4539148803436467 4539-1488-0343-6467-1 45391488034364670000",
    "tel +1 (212) 555-0199. ++49 30 123456 +1 2 +123456789012345678",
    "DE89 3704 0044 0532 0130 00 is an account; GB82WEST12345698765432 too; DE00370400440532013000 is none",
    "1" * 5000 + " " + "9 " * 5000 + "a" * 20000 + "@" + "b." * 3000,
    "😀 4539148803436467" * 40,
    "x@y.z\n" * 300,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, found string")


def test_base_spans_equal_plain_patterns(spark, docs):
    rows = pii.spans(docs.drop("found")).withColumn("l", pii.listed(F.col("found"))).collect()
    for r in rows:
        base = [x for x in r.l.split(",") if x and not x.startswith("iban")]
        assert base == [":".join(map(str, x)) for x in brute(r.text)], r.text and r.text[:60]
    assert sum(x.kind == "iban" for r in rows for x in r.found) == 2


def test_query_on_table(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(None, "a@b.co", None, None, None), (0, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op2_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    text = ",".join(":".join(map(str, x)) for x in brute(TEXTS[2]))
    assert by[2].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and by[2].n_email == 5
    assert by[None].spans == "email:0:6" and by[1].spans == ""


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert pii.op2_pii(spark, str(tmp_path)).count() == 0


def test_context_raises_score(spark):
    df = spark.createDataFrame([(1, "server 10.0.0.1"), (2, "zzz 10.0.0.1")], "doc_id long, text string")
    score = {r.doc_id: r.found[0].score for r in pii.spans(df).collect()}
    assert score == {1: 0.8, 2: 0.6}
