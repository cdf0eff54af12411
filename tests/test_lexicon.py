import pytest
from pyspark.sql import functions as F

from wordmill.functions import grammar, text
from wordmill.operators import exact, fuzzy, stats, wildcard
from wordmill.sources import lexicon


@pytest.fixture(scope="module")
def forms(spark):
    df = lexicon.forms(spark).cache()
    df.count()
    return df


def words(spark, *tokens):
    return spark.createDataFrame([(t, t.lower()) for t in tokens], "token string, folded string")


@pytest.mark.parametrize(
    "line,expected",
    [
        ("walk|0|s|ing|ed|ed\tV\tLID:1", {(0, "walk"), (1, "walks"), (2, "walking"), (3, "walked"), (4, "walked")}),
        ("abet|0|s|ting|ted|ted V LID:2", {(0, "abet"), (1, "abets"), (2, "abetting"), (3, "abetted"), (4, "abetted")}),
        ("|go|goes|going|went|gone V LID:3", {(0, "go"), (1, "goes"), (2, "going"), (3, "went"), (4, "gone")}),
        ("f|ar|arther/urther|arthest/urthest ADV LID:4", {(0, "far"), (1, "farther"), (1, "further"), (2, "farthest"), (2, "furthest")}),
        ("Andrew|0|'s|-|- NAME LID:5", {(0, "Andrew"), (1, "Andrew's")}),
        ("after PREP LID:6", {(255, "after")}),
        ("father|0|s N LID:7 post:-in-law", {(0, "father-in-law"), (1, "fathers-in-law")}),
        ("Stoke-on-Trent|0 NAME LID:8", {(0, "Stoke-on-Trent")}),
    ],
)
def test_expansion(spark, line, expected):
    df = lexicon.expand(lexicon.articles(spark.createDataFrame([(line,)], "line string")))
    assert {(r.form_id, r.surface) for r in df.collect()} == expected


def test_rejects_and_files(spark, tmp_path):
    (tmp_path / "a.dic").write_text("// comment\n\nwalk|0|s V LID:7\nbad LID:0\nx YY LID:3\nxLID:3\n", "utf-8")
    (tmp_path / "b.dic").write_bytes("кот|0 N LID:9\n".encode("cp1251"))
    lines = lexicon.article_lines(spark, [str(tmp_path / "a.dic")])
    assert [r.lexeme_id for r in lexicon.articles(lines).collect()] == [7]
    assert sorted(r.reject for r in lexicon.rejects(lines).collect()) == ["comment", "no number", "number 0", "part of speech"]
    other = lexicon.article_lines(spark, [str(tmp_path / "b.dic")], "windows-1251")
    assert [r.raw for r in lexicon.articles(other).collect()] == ["кот"]


def test_golden_words(spark, forms):
    known = lambda *t, **k: {r.token for r in exact.check_word(words(spark, *t), forms, **k).collect()}
    assert known("check", "chek", "checkerr", "VeRiFy", "CHECK") == {"check", "CHECK"}
    assert known("check", "ChEcK", "CHECK", "andrew", "Andrew", ignore_case=False) == {"check", "CHECK", "Andrew"}
    found = {(r.token, r.lemma) for r in exact.lemmatize(words(spark, "was", "andrew", "Andrew"), forms).collect()}
    assert found == {("was", "be"), ("andrew", "Andrew"), ("Andrew", "Andrew")}
    assert {r.surface for r in exact.build_form(forms, 100, 5).collect()} == {"were"}
    assert {r.surface for r in exact.find_forms(words(spark, "andrew"), forms, 1).collect()} == {"Andrew's"}
    assert exact.part_of_speech(spark.createDataFrame([(0,), (100,)], "lexeme_id long"), lexicon.lexemes(forms)).orderBy("lexeme_id").collect()[0].pos == 0


def test_every_form_comes_back_to_its_lexeme(spark, forms):
    tokens = forms.select(F.col("surface").alias("token"), F.col("form").alias("folded"), "lexeme_id").distinct()
    back = exact.lemmatize(tokens.select("token", "folded"), forms, ignore_case=False).select("token", "lexeme_id").distinct()
    assert tokens.join(back, ["token", "lexeme_id"], "left_anti").count() == 0


@pytest.mark.parametrize(
    "word,scheme,ok",
    [
        ("word", 0x0100, "tff"), ("Word", 0x0101, "ttf"), ("WORD", 0x0102, "ttt"), ("I", 0x0102, "ttt"), ("wOrd", 255, "fff"), ("WOrd", 255, "fff"),
        ("it's", 0x0100, "tff"), ("JOHN'S", 255, "fff"), ("abc1", 255, "fff"), ("New-York", 0x0205, "ttf"), ("NEW-YORK", 0x020A, "ttt"), ("New-york", 0x0201, "tff"),
        ("new-York", 0x0204, "fff"), ("Stoke-on-Trent", 0x0311, "ttf"), ("A-B-C", 0x032A, "ttt"), ("abc-", 0x0200, "tff"), ("-abc", 255, "fff"), ("a-b-c-d", 0x0400, "fff"),
    ],
)
def test_capitalization(spark, word, scheme, ok):
    s = text.cap_scheme(F.lit(word))
    r = spark.range(1).select(s.alias("s"), *[text.cap_allowed(s, F.lit(k)).alias(f"k{k}") for k in (0, 1, 2)]).first()
    assert r.s == scheme and "".join("t" if r[f"k{k}"] else "f" for k in (0, 1, 2)) == ok


def test_wildcards(spark, forms):
    assert wildcard.like("A*_b?") == r"a%\_b_" and wildcard.is_asterisk("**") and wildcard.is_wildcard("a?")
    one, two = (wildcard.find_match(forms, p).collect() for p in ("w*", "w**"))
    assert sorted(one) == sorted(two) and len(one) > 3
    plan = wildcard.find_match(forms, "wa*k")._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" in plan


def test_unknown_forms_share_a_hypothesis(spark, forms):
    extracted = fuzzy.extract(forms)
    classed = fuzzy.classes(extracted)
    ending = fuzzy.endings(classed)
    index = fuzzy.suffix_index(fuzzy.models(extracted, classed), ending)
    none = spark.createDataFrame([], "pos int, share double"), spark.createDataFrame([], "pos int, form_id int, share double")
    got = fuzzy.lemmatize(spark.createDataFrame([("bleck",), ("blecks",), ("blecking",), ("q",)], "word string"), index, classed, ending, *none)
    by = {}
    for r in got.collect():
        by.setdefault(r.word, set()).add((r.class_id, r.stem_len))
    assert by["bleck"] & by["blecks"] & by["blecking"] and "q" not in by
    assert {r.lemma for r in got.where("word = 'blecking'").collect()} >= {"bleck"}


def test_plans_have_no_python_and_broadcast_the_lexicon(spark, forms):
    tokens = text.counted(text.tokens(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), keep=("lang",)), "lang")
    plan = stats.coverage(tokens, lexicon.forms(spark), "lang")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_grammar(spark):
    f = spark.range(19).select(F.col("id").cast("int").alias("f"))
    rows = f.select("f", grammar.unpack_noun(F.col("f"), F.lit(False)).alias("g"), grammar.unpack_noun(F.col("f"), F.lit(True)).alias("p")).where("g >= 0")
    back = rows.select("f", "p", grammar.pack_noun(F.col("g"), F.when(F.col("f") % 10 == 4, 1).otherwise(2)).alias("b")).collect()
    assert all(r.p == -1 for r in back if r.f < 10)
    assert all(r.b == r.f for r in back)
    adj = spark.range(66).select(F.col("id").cast("int").alias("f")).select("f", grammar.unpack_adjective(F.col("f")).alias("g"))
    assert {r.f for r in adj.select("f", grammar.pack_adjective(F.col("g"), F.lit(2)).alias("b")).where("b <> f").collect()} <= {4, 12, 20, 28, 36, 44, 52, 60}
    past = F.lit(grammar.PAST | 0x0040 | (1 << 9))
    one = spark.range(1).select(grammar.pack_verb(past, F.lit(2)).alias("p"), grammar.swap_level(F.lit(1), F.lit(1), past, F.lit(0)).alias("l"), grammar.dictionary_form(F.lit(25), past).alias("d")).first()
    assert (one.p, one.l, one.d) == (200, 3, 1 << 9)
    v = {"pl": (~0x800, 0x800), "gen": (~0x7000, 0x1000)}
    assert spark.range(1).select(grammar.token_algebra(F.lit("pl|gen"), F.lit(0x2001), v).alias("g")).first().g == 0x1801
