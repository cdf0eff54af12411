import pytest

from wordmill.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def result(spark):
    return {r.doc_id: r for r in toxicity.op4_toxicity(spark, SF).collect()}


def test_held_out_accuracy(spark, result):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    own = [(x.toxic, result[x.doc_id]) for x in labels if result[x.doc_id].held_out]
    assert len(own) > 50 and sum(t == r.predicted for t, r in own) >= 0.97 * len(own)
    assert {r.held_out for r in result.values()} == {True, False}


def test_locates_the_sentence(spark):
    rows = [(i, "all is well here. nothing to see! " + ("you are a gobbin. " if i % 4 == 0 else "fine day. ") + "the end") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(400)) and all(got[i].worst == 2 for i in range(0, 400, 4))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "!!!", "c"), (None, "words", "d"), (3, "x " * 100000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fitted(docs, none)).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.5 for r in got) and [r.score for r in got if r.doc_id in (1, 2)] == [0, 0]
    out = toxicity.accepted(docs, none)
    assert out.columns == docs.columns and out.count() == 5
    assert toxicity.scored(docs.limit(0), toxicity.fitted(docs.limit(0), none)).count() == 0
