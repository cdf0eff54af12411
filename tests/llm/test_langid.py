import pytest

from wordmill.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in langid.op8_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    own = [(d.lang, got[d.doc_id].lang_pred) for d in docs if got[d.doc_id].held_out and got[d.doc_id].lang_pred != "und"]
    assert len(own) > 100 and sum(a == b for a, b in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 for r in got.values())


ROWS = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (None, "words here", "en"), (5, "ein text " * 30000, None), (6, "ß", "de"), (6, "ß", "de"), (7, "x" * 200000, "en")]


@pytest.mark.parametrize("rows", [ROWS, [(1, "some words", "en")], [(1, "abc", None)], []])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, score string")
    got = langid.predicted(docs, langid.fitted(docs)).collect()
    assert len(got) == len(rows)
    learned = {r[2] for r in rows if r[2] and r[0] is not None and r[1] and any(c.isalpha() for c in r[1])}
    for r in got:
        assert r.lang_pred in (learned or {"und"}) | ({"und"} if r.doc_id in (1, 2, 3) else set())
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3))
