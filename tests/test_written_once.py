"""What several steps of a plan use is written once: the plans behind it don't read the documents again."""

import pytest

from wordmill.plans import catalog, documents, russian
from wordmill.sources import files, stored

SF = "/root/testdata/sf0.001"


def reads(frame):
    """The files under a plan, by the last parts of their names."""
    return [x for x in frame.inputFiles() if "documents.parquet" in x or "wordmill_" in x]


@pytest.fixture(scope="module")
def made(spark):
    """What ``stored.once`` is given to save, by the query's module."""
    out = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(stored, "once", lambda spark, what, make: make())
        out["russian"] = russian.lexicon(spark, SF)
        out["documents"] = documents.documents_lexicon(spark, SF)
    return out


def test_written_equals(spark):
    own = spark.range(7).selectExpr("id", "id % 2 AS x")
    assert sorted(files.written(own).collect()) == sorted(own.collect())
    assert files.written(own.where("id < 0")).count() == 0


def test_russian_tables_are_trained_from_written_ones(spark):
    """russian_fuzzy, russian_models, russian_classes."""
    assert not [x for frame in russian._trained(spark, SF) for x in reads(frame)]


def behind(spark, made, name):
    """The plan that a query, or the lexicon it reads, is made by."""
    return made["russian"] if name in LEXICON else {**made, **dict.fromkeys(STEMS, russian.resolved(spark, SF)[0])}[name]


#: Queries over the stems of the articles, and over the saved forms of the Russian chain.
STEMS = ("russian_first_forms", "russian_article_stems")
LEXICON = ("russian_find_forms", "russian_round_trip", "russian_lemmatize", "russian_forms", "russian_models", "russian_classes")
SETTLED = [
    "russian_article_stems",
    "russian_forms",
    "russian_classes",
    "russian_first_forms",
    "russian_lemmatize",
    "russian_round_trip",
    "russian_find_forms",
    "russian_models",
]


@pytest.mark.parametrize("name", SETTLED)
def test_documents_are_read_once(spark, made, name):
    assert not reads(behind(spark, made, name))


@pytest.mark.parametrize("name", ["docs_find_match_double", "sql_lemmatize", "docs_build_form"])
def test_documents_lexicon_is_made_of_written_words(made, name):
    assert not reads(made["documents"])


def test_weights_are_tuned_over_written_samples(spark, monkeypatch):
    from wordmill.operators import training
    from wordmill.plans import compilers

    given = []
    monkeypatch.setattr(training, "tuned", lambda samples, start, *a: (given.append(samples), (start, 0.0))[1])
    compilers.tuned_weights(spark, SF)
    assert given and not reads(given[0])


@pytest.mark.parametrize("name", ["fuzzy_lemmatize", "docs_fuzzy_lemmatize", "exact_then_fuzzy"])
def test_hypotheses_are_made_of_written_words(spark, name):
    """The words whose counts give the priors, and those looked up, are one written table."""
    assert not [x for x in catalog.QUERIES[name](spark, SF).inputFiles() if "documents.parquet" in x]


def test_words_are_counted_before_they_are_written_in_cyrillic(spark):
    """russian_lemmatize: nothing below the first count rewrites every occurrence."""
    plan = catalog.QUERIES["russian_lemmatize"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" in plan and "translate" not in plan[plan.rindex("Aggregate") :]


def test_counted_words_are_looked_up_with_their_counts(spark):
    """Two that are one word when folded add up."""
    own = russian.lexicon(spark, SF)
    form = own.forms.first()["form"]
    given = spark.createDataFrame([(form, 3), (form.upper(), 4)], "token string, n long")
    assert {r["n"] for r in own.lemmatize(given, "n").collect()} == {7}
