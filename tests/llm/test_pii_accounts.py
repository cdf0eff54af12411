"""Account numbers next to words and digits that could belong to them."""

import re

from pyspark.sql import functions as F

from wordmill.llm import pii

DE, DE_SPACED, GB = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
#: A text and the numbers in it.
CASES = [
    (f"{DE} Please pay", [DE]),
    (f"{DE_SPACED} Bank of X", [DE_SPACED]),
    (f"IBAN {DE_SPACED} BIC COBADEFF", [DE_SPACED]),
    (f"{DE} 2 days", [DE]),
    (f"{GB} IBAN", [GB]),
    (f"{DE} {GB} {DE_SPACED} {GB}", [DE, GB, DE_SPACED, GB]),
    (f"AB12 {DE} 12 345", [DE]),
    (f"é😀 {DE_SPACED} A B C D E F G H I J K L M N O P", [DE_SPACED]),
    ("NO9386011117947 NO93 8601 1117 947 X", ["NO9386011117947", "NO93 8601 1117 947"]),
    ("MT84MALT011000012345MTLCAST001S END", ["MT84MALT011000012345MTLCAST001S"]),
    (f"x{DE} {DE}x {DE}1 {DE[:-1]} DE00370400440532013000 A", []),
    (f"{DE[:-1]}", []),
    ("DZ580002100001113000000570 X", ["DZ580002100001113000000570"]),
]


def mod97(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def test_the_cases_are_valid():
    assert all(mod97(re.sub(" ", "", x)) == 1 for _, numbers in CASES for x in numbers)


def test_numbers_before_capitals_and_digits(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    found = pii.spans(docs).select("text", F.filter("found", lambda x: x["kind"] == "iban").alias("found")).collect()
    assert {r.text: [r.text[x.s : x.e] for x in r.found] for r in found} == dict(CASES)


def test_a_text_full_of_beginnings(spark):
    text = "AB12 " * 3000 + DE
    (row,) = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [text[x.s : x.e] for x in row.found if x.kind == "iban"] == [DE]


def test_context_on_both_sides(spark):
    rows = [(1, "192.168.0.1 is the host"), (2, "host 192.168.0.1"), (3, "192.168.0.1 is " + "x" * 40 + " host"), (4, "192.168.0.1")]
    from wordmill.llm import pii

    got = {r.doc_id: r.found[0].score for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0.8, 2: 0.8, 3: 0.6, 4: 0.6}
