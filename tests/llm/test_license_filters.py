"""What the length and positional filters of the license join remove, and that they lose nothing."""

from wordmill.llm import licenses

TEMPLATES = {"t": "alpha beta gamma delta epsilon", "u": "zeta eta theta iota kappa"}


def test_positional_filter_removes_pairs(spark):
    # frequencies order the words: alpha is the rarest, epsilon the most frequent; those of u come between
    common = [" ".join(["epsilon"] * 9 + ["delta"] * 8 + ["gamma"] * 7 + ["beta"] * 6 + ["zeta"] * 2 + ["eta"] * 2 + ["theta"] * 2 + ["iota"] * 2 + ["kappa"] * 2)] * 2
    texts = ["zeta eta theta beta", "zeta eta alpha beta gamma delta", "beta gamma delta epsilon", "zeta eta iota kappa theta epsilon", *common]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = lambda on: {(r.doc_id, r.label) for r in licenses.candidates(docs, TEMPLATES, 0.8, on).collect()}
    every, kept = pairs(False), pairs(True)
    # document 0 has four of the templates' words, but only beta from its first common word with t on
    assert kept < every and (0, "t") in every - kept
    found = {(r.doc_id, r.label) for r in licenses.similar_blocks(docs, TEMPLATES, 0.8).collect()}
    assert found <= kept and {(1, "t"), (2, "t"), (3, "u")} <= found


def test_no_templates(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    r = licenses.scanned(docs, templates={}).first()
    assert r.n_words == 2 and not r.blocks and len(r.places) == 1
