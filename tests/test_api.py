"""Analysers as objects, and what only files or loops can show."""

import pytest
from pyspark.sql import functions as F

from wordmill import api
from wordmill.operators import fuzzy, training
from wordmill.plans import catalog
from wordmill.sources import lexicon, notation, tables


def test_exact(spark):
    a = api.Exact(spark)
    assert {r.token for r in a.check_word(["Moved", "andrew", "Andrew", "qqq"]).collect()} == {"Moved", "Andrew"}
    assert {r.token for r in a.check_word(["andrew"], ignore_case=True).collect()} == {"andrew"}
    assert [(r.lexeme_id, r.lemma, r.grams) for r in a.lemmatize("went").collect()] == [(3000, "go", [3])]
    assert {r.surface for r in a.build_form("went", 2).collect()} == {"going"} and a.build_form(3000, 4).first().surface == "gone"
    assert {r.surface for r in a.find_forms("was", 0).collect()} == {"be"}
    assert a.part_of_sp(100) == 19 and a.part_of_sp(99) == 0
    got = a.find_match("go*", lambda lexeme, found: [(lexeme, f) for f, _ in found], "lexeme_id long, form string").collect()
    assert {(r.lexeme_id, r.form) for r in got} == {(3000, "go"), (3000, "goes"), (3000, "going"), (3000, "gone")}


def test_fuzzy(spark):
    a = api.Fuzzy(spark)
    best = a.lemmatize("blicked").where("rank = 1").first()
    assert best.lemma in ("blick", "blicke") and best.word[: best.stem_len] + "" == "blicked"[: best.stem_len]
    assert a.build_form("blick", best.class_id, 2).first().form.startswith("blick")
    assert a.part_of_sp(best.class_id) == best.pos and a.get_sample(best.class_id)
    assert a.get_sample(10_000) == [] and a.part_of_sp(10_000) == 0


def test_length_prior(spark):
    r = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 6, 8, 9, 20)], "n int")
    got = r.orderBy("n").select(F.round(fuzzy.score(F.col("n"), F.lit(1), F.lit(0.0), F.lit(0.0)) / 0.4, 6).alias("s")).collect()
    assert [x.s for x in got] == [0.0, 0.05, 0.17, 0.55, 0.85, 0.97, 0.99, 1.0, 1.0, 1.0]


def test_documents_are_read_once(spark):
    df = catalog.QUERIES["fuzzy_top1"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1


def test_large_lexicon_is_not_broadcast(spark):
    spec = "0|s|ing|ed|ed"
    lines = spark.range(60_000).select(F.concat(F.lit("stem"), F.conv(F.col("id").cast("string"), 10, 36), F.lit(f"q|{spec}\tV\tLID:"), (F.col("id") + 1).cast("string")).alias("line"))
    forms = lexicon.expand(lexicon.articles(lines))
    assert forms.count() == 300_000
    a = api.Exact(spark, forms)
    got = a.lemmatize(["stem1q", "STEMAqing", "stemzzzzzzq"], ignore_case=True)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.token, r.lexeme_id, tuple(r.grams)) for r in got.collect()} == {("stem1q", 2, (0,)), ("STEMAqing", 11, (2,))}


def test_saved_forms_and_rejects(spark, tmp_path):
    forms = lexicon.forms(spark)
    lexicon.save(forms, str(tmp_path / "forms"))
    back = lexicon.load(spark, str(tmp_path / "forms"))
    assert not back.select(forms.columns).exceptAll(forms).count() and back.count() == forms.count()
    lines = spark.createDataFrame([("// c",), ("x N",), ("a|0|s\tN\tLID:5",)], "line string")
    lexicon.write_rejects(lines, str(tmp_path / "rejects"))
    assert {r.value for r in spark.read.text(str(tmp_path / "rejects")).collect()} == {"// c", "x N"}


def test_code_pages(spark):
    assert len(notation.CODE_PAGES) == 24
    for page in notation.CODE_PAGES:
        r = spark.createDataFrame([("Слово word ё",)], "t string").select(lexicon.from_code_page(lexicon.to_code_page(F.col("t"), page), page).alias("b")).first()
        assert r.b.lstrip("﻿") == "Слово word ё", page


def test_class_files_keep_accents(spark, tmp_path):
    classed = spark.createDataFrame([(1, 7, "0:,1:а", 3, True)], "class_id int, pos int, endings string, n long, accent boolean")
    model = spark.createDataFrame([(1, "ож", "нож", 3)], "class_id int, suffix string, sample string, weight long")
    tables.class_json(classed, model, fuzzy.endings(classed)).select(F.concat(F.lit('{"classes":['), "json", F.lit("]}"))).coalesce(1).write.text(str(tmp_path / "c"))
    r = tables.read_classes(spark, str(tmp_path / "c")).first()
    assert (r.class_id, r.pos, r.accent, len(r.inflex)) == (1, 7, True, 2)


def test_merging_goes_on_to_the_end(spark):
    rows = [(1, 1, "0:", 9), (2, 1, "0:,1:s", 5), (3, 1, "0:,1:s,2:t", 2), (4, 1, "0:x", 7), (5, 2, "0:", 1)]
    merged = fuzzy.merge_classes(spark.createDataFrame(rows, "class_id int, pos int, endings string, n long"))
    assert {tuple(r) for r in merged.collect()} == {(1, 3), (2, 3)}
    model = spark.createDataFrame([(1, "ab", "b", 2), (3, "ab", "a", 1), (5, "ab", "z", 4)], "class_id int, suffix string, sample string, weight long")
    assert {tuple(r) for r in fuzzy.merged_models(model, merged).collect()} == {(3, "ab", "a", 3), (5, "ab", "z", 4)}


def test_tuning_lowers_the_loss(spark):
    rows = [(10, 0.9, 4, 1), (3, 0.5, 1, 0), (7, 0.8, 5, 1), (2, 0.9, 0, 0)]
    samples = spark.createDataFrame(rows, "n long, power double, ending_len int, hit int")
    start = [0.5, 0.2, 3.0]
    before = training.loss(samples, [start])[0]
    weights, after = training.tuned(samples, start, [0.0, 0.0, 0.0], [1.0, 5.0, 10.0])
    assert after < before and all(0 <= w <= 10 for w in weights)
    assert training.loss(samples, [weights])[0] == pytest.approx(after)


def test_unknown_grammar_token(spark):
    with pytest.raises(Exception, match="unknown token zz"):
        tables.token_values(spark, notation.RUSSIAN_TOKENS, ["И|zz"]).collect()
