"""The pipeline's stages on odd rows, and the whole of it."""

import pytest

from tests.llm.test_jaccard import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, gone string"


def rows():
    run = "a first line of the passage\nand a second one\nthen the third"
    out = [(1, run + "\nalone here", "en", "web", 5), (2, run + "\nsomething else", "en", "web", 5), (3, None, None, None, None), (4, "", "en", None, 0), (None, "no id " * 9, "en", "web", 54)]
    out += [(5, "the same text stands twice in two rows", "en", "wiki", 1)] * 2 + [(6, "the same text stands twice in two rows", "en", "wiki", 1), (7, "long " * 60_000, "en", "book", 1)]
    return [(*x, "t", "g") for x in out]


def test_every_stage_takes_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 0), (5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and dict(out.dtypes)["target"] == "string"
            docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = out.collect() if name == "bpe" else docs.collect()
    assert len(kept["toxicity"]) == len(rows())
    lined = {r.doc_id: r.text for r in kept["line_dedup"]}
    assert lined[2] == "something else" and lined[1].startswith("a first") and lined[3] is None and lined[4] == ""
    single = [r.doc_id for r in kept["ngram_jaccard"]]
    # equal rows of one doc_id are one document; both stay, and the copy under another id goes
    assert sorted(map(str, single)) == sorted(map(str, [1, 2, 3, 4, None, 5, 5, 7])) and brute([(5, rows()[5][1]), (6, rows()[7][1])])[6][1] == 5
    assert {r.doc_id for r in kept["mixing"]} <= set(single)
    assert {r.doc_id for r in kept["bpe"]} == {r.doc_id for r in kept["mixing"]} and all(r.n_tokens == len(r.ids) for r in kept["bpe"])


def test_whole_run_and_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert out and {r.doc_id for r in out} <= ids
