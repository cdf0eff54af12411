"""Walks through ending tables, stripping and building, against plain Python and rows worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from wordmill.operators import exact
from wordmill.plans import compilers
from wordmill.sources import paradigms, resolver, tables


def strip_plain(tables_of, name, word, normal, masks, level=0):
    """Letters that go off, trying entries as the walk describes; None if nothing fits."""
    for _, ending, grammar, then in tables_of.get(name, []):
        mask = masks[level]
        if normal & mask != grammar & mask or (normal & mask == 0 and mask != 0xFFFF):
            continue
        if level < paradigms.LAST and then:
            inner = strip_plain(tables_of, then, word, normal, masks, level)
            if inner is not None and word[: len(word) - inner].endswith(ending):
                return inner + len(ending)
        elif word.endswith(ending):
            return len(ending)
    return strip_plain(tables_of, name, word, normal, masks, level + 1) if level + 1 < len(masks) else None


def expand_plain(tables_of, name):
    for _, ending, grammar, then in tables_of.get(name, []):
        if then is None:
            yield ending, grammar
        else:
            for tail, g in expand_plain(tables_of, then):
                yield ending + tail, grammar | g


@pytest.mark.parametrize("verb", [False, True])
def test_walks_against_plain_python(spark, verb):
    rnd = random.Random(7)
    normal = 0x8001 if verb else 0x0200
    masks = paradigms.VERB_LEVELS if verb else paradigms.NOUN_LEVELS
    parsed, tables_of = [], {}
    for t in range(12):  # tables go on with later ones only
        for place in range(rnd.randint(1, 5)):
            then = f"t{rnd.randint(t + 1, 11)}" if t < 9 and rnd.random() < 0.4 else None
            ending, grammar = "".join(rnd.choice("аб") for _ in range(rnd.randint(0, 2))), rnd.choice([normal, normal, 1, 0x8000, 0, 12])
            parsed.append((f"t{t}", ending, grammar, then, 255))
            tables_of.setdefault(f"t{t}", []).append((place, ending, grammar, then))
    rows = paradigms.table_rows(spark, parsed)
    assert {(r["name"], r["ending"], r["grammar"]) for r in paradigms.whole_endings(rows).collect()} == {(t, *x) for t in tables_of for x in expand_plain(tables_of, t)}
    words = [(i, t, "".join(rnd.choice("аб") for _ in range(6)), normal, verb) for i, t in enumerate(list(tables_of) * 20)]
    table = spark.createDataFrame(words, "id int, table string, base string, normal int, verb boolean")
    ends = paradigms.normal_ends(rows)
    got = {r["id"]: r["off"] for r in paradigms.stripped(table, ends, ["id"]).collect()}
    # plain Python stops at the first fit of each inner table; the list also tries that table's other entries
    for i, t, base, _, _ in words:
        want = strip_plain(tables_of, t, base, normal, masks)
        if want is not None and not any(x[3] for x in tables_of[t]):
            assert got.get(i) == want
        if want is None and not any(x[3] for x in tables_of[t]):
            assert i not in got


def test_a_table_that_goes_on_with_itself(spark):
    rows = paradigms.table_rows(spark, [("t", "а", 0, "t", 255)])
    with pytest.raises(Exception, match="(?i)recursion"):
        paradigms.whole_endings(rows).collect()


def _chain(spark, lines):
    rows = paradigms.table_rows(spark, tables.parse_tables([x for x in compilers.ENDING_LINES if x], compilers._grammar))
    alternations = compilers._alternations(spark)
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    return rows, alternations, paradigms.resolved(table, rows, alternations)


def test_stems_of_the_fixed_articles(spark):
    """The walk takes the same endings off as were worked out by hand."""
    _, _, found = _chain(spark, [x for (x,) in compilers.ARTICLES])
    got = {(r["line"], r["index"]): tuple(r[c] for c in ("wd", "stem", "postfix", "table", "alternation", "cases", "reject")) for r in found.collect()}
    assert got == {(r[0], r[1]): (r[2], r[3], r[4], r[5], r[6], r[7], r[8]) for r in compilers.STEMS}


def test_forms_through_alternations(spark):
    lines = ["рука # ж 3а", "дочка # жо 3*а", "читать # нсв 1а", "писать # нсв 6а -ш-", "новый # п 1а", "сани мн. ж 2а", "под # предл. ШП:ВТ", "он-то # мс 0 post:-то", "сын # мо 1а"]
    rows, alternations, found = _chain(spark, lines)
    stems = found.where("reject is null").withColumn("lexeme_id", F.xxhash64("line"))
    built = paradigms.forms(stems, rows, alternations)
    by_line = {r["lexeme_id"]: r["line"] for r in stems.select("lexeme_id", "line").collect()}
    got = {}
    for r in built.collect():
        got.setdefault(by_line[r["lexeme_id"]], set()).add((r["form"], r["form_id"], r["lemma"]))
    assert got == {
        "рука # ж 3а": {("рука", 0, "рука"), ("руку", 3, "рука"), ("рукой", 5, "рука")},
        "дочка # жо 3*а": {("дочка", 0, "дочка"), ("дочку", 3, "дочка")},
        "читать # нсв 1а": {("читать", 0, "читать"), ("читаться", 1, "читать"), ("читаю", 18, "читать")},
        "писать # нсв 6а -ш-": {("писать", 0, "писать"), ("пишу", 18, "писать")},
        "новый # п 1а": {("новый", 0, "новый"), ("новая", 8, "новый")},
        "сани мн. ж 2а": {("сани", 10, "сани")},
        "под # предл. ШП:ВТ": {("под", 255, "под")},
        "он-то # мс 0 post:-то": {("он-то", 255, "он-то")},
        "сын # мо 1а": {("сын", 0, "сын"), ("сына", 1, "сын")},
    }
    # round trip: every form is found again, as a form of its own article
    tokens = built.select(F.col("form").alias("token"), F.col("form").alias("folded"), F.col("lexeme_id").alias("own")).distinct()
    back = exact.hits(tokens, built.drop("wd", "grammar")).where("own = lexeme_id").select("token", "own").distinct()
    assert back.count() == tokens.count()
    first = {by_line[r["lexeme_id"]]: r["form"] for r in paradigms.first_forms(stems, rows, alternations).collect()}
    assert first["писать # нсв 6а -ш-"] == "писать" and first["рука # ж 3а"] == "рука" and first["под # предл. ШП:ВТ"] == "под" and first["читать # нсв 1а"] == "читать"


def test_a_level_that_an_alternation_lacks_has_no_form(spark):
    rows = paradigms.table_rows(spark, [("ж 1", "а", 0, None, 255), ("ж 1", "", 0x1800, None, 255)])
    stems = spark.createDataFrame([(1, "ру", 13, "ж 1", 0, "")], "lexeme_id long, stem string, wd int, table string, alternation int, postfix string")
    alternations = spark.createDataFrame([("ж 1", 0, "о", 1, "к")], "name string, place int, condition string, level int, text string")
    assert [r["form"] for r in paradigms.forms(stems, rows, alternations).collect()] == ["рука"]


def test_resolver_without_the_walk_is_as_before(spark):
    found = resolver.resolved(spark.createDataFrame(compilers.ARTICLES, "line string"), compilers._endings(spark), compilers._alternations(spark))
    assert {(r["line"], r["index"]): r["stem"] for r in found.collect()} == {(r[0], r[1]): r[3] for r in compilers.STEMS}
