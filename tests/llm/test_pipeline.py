import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm import test_jaccard, test_lines, test_mixing
from wordmill.llm import bpe, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    calm, lined, single, mixed = kept

    raw = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(toxicity.F.col("doc_id")))
    good = {r.doc_id for r in toxicity.scored(raw, toxicity.fitted(raw, labels)).collect() if r.score < 0.5}
    assert {d for d, _ in calm} == good
    assert dict(lined) == test_lines.brute(calm)
    assert sorted(d for d, _ in single) == sorted(d for d, (_, c) in test_jaccard.brute(lined).items() if d == c)
    texts = dict(single)
    source = {r.doc_id: r.source for r in raw.collect()}
    sizes = {d: len(test_mixing.re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in single}
    targets = test_mixing.brute_targets([(source[d], sizes[d]) for d, _ in single])
    copies = Counter(d for d, _ in mixed)
    assert set(copies.values()) <= {1, 2} and all(texts[d] == t for d, t in mixed)
    total = sum(sizes[d] * n for d, n in copies.items())
    assert abs(total - sum(targets.values())) <= 0.1 * sum(targets.values())

    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in final) == copies
    assert all(hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == r.decoded_sha256 for r in final)
    assert all(r.n_tokens == len(r.ids) and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in final)
    assert bpe.decode(final[0].ids, bpe.vocabulary_bytes()).decode() == texts[final[0].doc_id]


def test_labels_of_the_fixture():
    assert "toxic" in pq.read_schema(f"{SF}/labels.parquet").names
