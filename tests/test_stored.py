"""A derived lexicon, its saved tables and their filter, and patterns in a table, against plain Python."""

import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from wordmill.functions import text as T
from wordmill.operators import fuzzy, patterns, wildcard
from wordmill.sources import derived, stored

SF = "/root/testdata/sf0.001"
WORDS = "walk Walk walks walking walked walkings walker TPC tpcs sing sings singing singed ring rings bring was % a_b a%b café cafés à x xy".split()


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "token string")


@pytest.fixture(scope="module")
def forms(tokens):
    return derived.forms(derived.vocabulary(tokens)).cache()


@pytest.fixture(scope="module")
def corpus(spark):
    return T.tokens(spark.read.parquet(f"{SF}/documents.parquet"), least=1)


@pytest.fixture(scope="module")
def saved(corpus):
    own = stored.store(derived.forms(derived.vocabulary(corpus)), "test_forms")
    yield own
    own.drop()


def test_derived_forms(forms):
    words = {w.lower() for w in WORDS if len(w) >= 3}
    want = {(w, i, e, w + e) for w in words for i, e in enumerate(derived.ENDINGS) if w + e in words}
    got = {(r["lemma"].lower(), r["form_id"], r["ending"], r["form"]) for r in forms.collect()}
    assert got == want
    by = {r["form"]: r for r in forms.where("ending = ''").collect()}
    assert by["walk"]["min_cap"] == 0 and by["tpc"]["surface"] == "TPC"
    assert len({r["lexeme_id"] for r in by.values()}) == len(by) and all(1 <= r["pos"] <= 3 for r in by.values())


def test_saved_lexicon_finds_what_a_join_finds(corpus, saved):
    plain = saved.forms.select("form").distinct()
    want = {(r["folded"], r["n"]) for r in corpus.select(F.lower("token").alias("folded")).groupBy("folded").agg(F.count(F.lit(1)).alias("n")).join(plain, F.col("folded") == F.col("form"), "left_semi").collect()}
    assert {tuple(r) for r in saved.check_word(corpus).collect()} == want
    assert {(r["folded"], r["n"]) for r in saved.lemmatize(corpus).collect()} == want


def test_filter_lets_known_words_pass_and_few_others(spark, saved):
    known = saved.forms.select(F.col("form").alias("folded")).distinct()
    assert saved.maybe_known(known).count() == known.count()
    other = spark.range(20_000).select(F.concat(F.lit("q·"), F.col("id").cast("string")).alias("folded"))
    assert saved.maybe_known(other).count() < 800  # two of at least sixteen places


def test_one_exchange_and_no_broadcast_of_forms(spark, corpus, saved):
    plan = saved.lemmatize(corpus.select("token"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning\(folded", plan)) == 1
    assert "Exchange hashpartitioning(form" not in plan and "SelectedBucketsCount" in plan
    join = re.search(r"(\w+Join)[^\n]*\[folded#\d+\], \[form#\d+\]", plan)
    assert join and join[1] == "SortMergeJoin"


def test_too_large_filter_is_left_out(saved, corpus, monkeypatch):
    monkeypatch.setattr(stored, "MOST_BITS", 8)
    assert saved.maybe_known(corpus.select(F.lower("token").alias("folded"))).count() == corpus.count()


def test_empty_lexicon(spark, corpus):
    own = stored.store(derived.forms(derived.vocabulary(corpus.limit(0))), "test_none")
    assert own.check_word(corpus).count() == 0 and own.rows == 0
    own.drop()


PATTERNS = ["walk*", "WALK*", "*ing", "*in*", "w*k*s", "?ing", "????", "*", "??", "***", "s?ng", "sing", "zzz*", "wa?k**", "a_b", "a%b", "%", "*%*", "caf?", "*és", "", "?", "*g", "x?", "s*", "no", "w?*"]


def plain_matches(words, pattern):
    own = re.compile(fnmatch.translate(re.sub(r"([\[\]])", r"[\1]", pattern.lower())))
    return {w for w in words if own.match(w)}


@pytest.mark.parametrize("salts", [1, 5])
def test_patterns_against_plain_matching(spark, salts):
    words = {w.lower() for w in WORDS}
    forms = spark.createDataFrame([(w, i, 0) for i, w in enumerate(sorted(words))], "form string, lexeme_id long, form_id int")
    asked = spark.createDataFrame([(p,) for p in [*PATTERNS, "walk*", None]], "pattern string")
    got = {}
    for r in patterns.find_matches(forms, asked, salts).collect():
        assert r["form"] not in got.setdefault(r["pattern"], set())
        got[r["pattern"]].add(r["form"])
    assert got == {p: m for p in PATTERNS if (m := plain_matches(words, p))}


def test_pattern_table_equals_single_patterns(spark, forms):
    for p in ("w*", "*ing*", "????"):
        one = {tuple(r) for r in wildcard.find_match(forms, p).collect()}
        assert {tuple(r)[1:] for r in patterns.find_matches(forms, spark.createDataFrame([(p,)], "pattern string")).collect()} == one
        assert {tuple(r)[1:] for r in patterns.first_matches(forms, spark.createDataFrame([(p,)], "pattern string")).collect()} == {tuple(r) for r in wildcard.first_matches(forms, p).collect()}


def test_no_cross_join(spark, forms):
    asked = spark.createDataFrame([("w*",), ("??",)], "pattern string")
    plan = patterns.find_matches(forms, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_key_probes_equal_single_probes(spark, forms):
    extracted = fuzzy.extract(forms)
    classed = fuzzy.classes(extracted)
    index = fuzzy.suffix_index(fuzzy.models(extracted, classed), fuzzy.endings(classed)).cache()
    asked = ["*ing", "*?ng", "w*s", "?s", "walks", "*", "*?", "x*lk?"]
    got = {}
    for r in patterns.key_probes(index, spark.createDataFrame([(p,) for p in asked], "pattern string")).collect():
        got.setdefault(r["pattern"], set()).add(tuple(r)[1:])
    assert got == {p: m for p in asked if (m := {tuple(r) for r in fuzzy.wild_probe(index, p).collect()})}


def test_runs_of_bitmaps(spark):
    import random

    from wordmill.operators import stats

    rnd = random.Random(3)
    ids = sorted({rnd.randint(-70_000, 70_000) for _ in range(500)} | set(range(32_700, 32_900)) | set(range(-20, 5)) | {32_768, 65_536, -32_768, -65_536})
    table = spark.createDataFrame([(i,) for i in [*ids, ids[0]]], "lexeme_id long")
    found = {i for r in stats.runs(stats.pages(table)).collect() for i in range(r["first"], r["last"] + 1)}
    assert sorted(found) == ids
    free = {i for r in stats.runs(stats.complement(stats.pages(table))).collect() for i in range(r["first"], r["last"] + 1)}
    assert not free & found and {i for i in range(ids[0], ids[-1] + 1)} <= free | found
    assert {tuple(r) for r in stats.page_gaps(table).collect()} == {tuple(r) for r in stats.id_gaps(table).collect()}


def test_contained_classes_against_sets(spark):
    import random

    rnd = random.Random(4)
    rows = {}
    for i in range(10_000):
        e = sorted({f"{rnd.randint(0, 6)}:{rnd.choice(['', 'a', 'b', 'ab'])}" for _ in range(rnd.randint(1, 4))})
        rows.setdefault((rnd.randint(1, 2), ",".join(e)), i)
    classed = spark.createDataFrame([(i, p, e) for (p, e), i in rows.items()], "class_id int, pos int, endings string")
    sets = {i: (p, frozenset(e.split(","))) for (p, e), i in rows.items()}
    want = {(b, a) for b, (p, x) in sets.items() for a, (q, y) in sets.items() if p == q and x < y}
    got = fuzzy.contained(classed)
    assert {(r["class_id"], r["into"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def table_queries(spark, forms, asked):
    return {"find_match_table": patterns.find_matches(forms, asked), "find_first_match_table": patterns.first_matches(forms, asked), "find_match_table_grouped": patterns.grouped_matches(forms, asked)}


def broadcast_columns(frame):
    """What each broadcast of a plan sends."""
    query = frame._jdf.queryExecution()
    text = query.explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"BroadcastExchange *\nInput \[\d+\]: \[([^\]]*)\]", text)


@pytest.mark.parametrize("name", ["find_first_match_table", "find_match_table", "find_match_table_grouped"])
def test_postings_are_never_broadcast(spark, saved, name):
    """The saved forms are few and small here, which made Spark send all their postings, whose size it can't tell."""
    asked = spark.createDataFrame([("w*",), ("*ing",), ("?????????",)], "pattern string")
    sent = broadcast_columns(table_queries(spark, saved.forms, asked)[name])
    assert sent and not [x for x in sent if "form#" in x]


@pytest.mark.parametrize("salts", [1, 5])
def test_many_patterns_are_shuffled(spark, monkeypatch, salts):
    monkeypatch.setattr(patterns, "is_small", lambda t: False)
    monkeypatch.setattr(patterns, "for_join", lambda t: t.hint("merge"))
    test_patterns_against_plain_matching(spark, salts)


@pytest.mark.parametrize("name", ["lemmatize", "check_word"])
def test_filter_is_asked_for_distinct_words(corpus, saved, name):
    """The filter's joins stand above the count, not below it."""
    plan = getattr(saved, name)(corpus.select("token"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_page") < plan.index("Aggregate [folded")
    assert "_page" not in plan[plan.rindex("Aggregate [folded") : plan.index("Generate explode")]
