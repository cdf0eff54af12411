"""Plans of steps that several queries share: what they shuffle, and how often they read."""

import re

import pytest
from pyspark.sql import functions as F

from wordmill.operators import patterns
from wordmill.plans import documents, russian
from wordmill.sources import derived, files, paradigms

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_articles_are_resolved_without_shuffling_them(spark):
    rows, alternations = russian._tables(spark)
    lines = files.written(russian.article_lines(spark, SF).select("line"))
    found = plan(paradigms.resolved(lines, rows, alternations))
    assert "SortMergeJoin" not in found and "Exchange hashpartitioning(id" not in found and "Exchange hashpartitioning(table" not in found


def test_forms_are_dealt_by_lexeme_once(spark):
    stems, rows, alternations = russian.resolved(spark, SF)
    found = plan(paradigms.forms(stems, rows, alternations))
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning\(lexeme_id", found)) == 1 and "SortMergeJoin" not in found


def test_first_forms_are_built_without_shuffling_stems(spark):
    assert "SortMergeJoin" not in plan(paradigms.first_forms(*russian.resolved(spark, SF)))


@pytest.mark.parametrize("name", ["stored_check_word", "stored_lemmatize"])
def test_documents_are_cut_once_for_lexicon_and_lookup(spark, name):
    assert not [x for x in documents.QUERIES[name](spark, SF).inputFiles() if "documents.parquet" in x]


def test_tokens_are_counted_before_they_are_folded(spark):
    own = spark.createDataFrame([("Ab",), ("AB",), ("ab",), ("AB",), ("x" * 48,), ("Q",)], "token string")
    found = derived.vocabulary(own)
    assert {tuple(r) for r in found.collect()} == {("ab", 4, 0), ("q", 1, 2)}
    told = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lower" not in told[told.rindex("Aggregate [token") :].split("\n", 1)[1]


def test_patterns_are_a_plan_of_their_own(spark):
    """The plan that finds matches does not hold the table that the patterns are made of."""
    forms = spark.createDataFrame([("walking", 1, 0)], "form string, lexeme_id long, form_id int")
    made = patterns.matching(forms, documents.asked(spark, SF))
    assert not [x for x in made.inputFiles() if "benchmark" in x]
    asked = spark.createDataFrame([("*king",), ("?alk*",), ("zz*",)], "pattern string")
    assert {r["pattern"] for r in patterns.matching(forms.select("form", F.lit(2).alias("lexeme_id")), asked).collect()} == {"*king", "?alk*"}
