"""From lines of a Russian dictionary to stems with their tables.

endings(name, ending, grammar, flags) are whole endings, as ``tables.expand_endings``
gives them; alternations(name, place, condition, level, text) are what
``tables.parse_alternations`` gives. A name is "type index" of an article.

A line resolves if its part of speech is known and, where the word is inflected, its
table of endings is too. What the normal form ends with goes off: all from an ``@`` on;
else the longest ending of the normal form's grammar, or, for a verb, of an infinitive
without regard to the reflexive bit. Then the first alternation of the name whose
condition holds, and whose first text the stem ends with, takes that text off as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.functions import grammar as G
from wordmill.sources import notation, tables


def pos_map(spark: SparkSession) -> DataFrame:
    """key, wd: a row for each of the fixed keys."""
    return spark.createDataFrame(notation.pos_rows(), "key string, wd int")


def holds(condition: Column, stem: Column) -> Column:
    """Whether an alternation's condition holds for the end of a stem, the letter before the last as a rule."""
    before, third = F.substring(stem, -2, 1), F.substring(stem, -3, 1)
    long = F.length(stem) >= 3
    among = lambda x, letters: (F.length(stem) >= 2) & x.isin(*letters)
    return (
        F.when(condition == "ле", long & (F.substring(stem, -3, 2) == "ле"))
        .when(condition == "ге", long & among(third, notation.VOWELS) & (before == "е"))
        .when(condition == "ш", among(before, notation.HISSING))
        .when(condition == "к", among(before, notation.VELAR))
        .when(condition == "ь", among(before, "ь"))
        .when(condition == "й", among(before, "й"))
        .otherwise(condition == "о")
    )


def verb_mix(index: Column) -> Column:
    """Which of the three ways a verb's alternation goes, by the index of its conjugation: 0, 1 or 2."""
    one = index.rlike(r"^([69]|5\*?c/c|10|14)")
    return F.when(index.startswith("11"), 2).when(one, 1).otherwise(0)


def normal_grammar(wd: Column, stem: Column) -> Column:
    """The grammar word of a normal form: reflexive infinitive for verbs, masculine for what has genders."""
    code = G.pos(wd)
    plural = F.when(G.x_and(wd, G.PLURAL_ONLY) != 0, G.PLURAL).otherwise(0)
    gender = (1 << 9) + F.when((F.length(stem) > 2) & stem.endswith("ся"), G.REFLEXIVE).otherwise(0)
    return F.when(G.is_verb(wd), G.INFINITIVE | G.REFLEXIVE).when(code.isin(*notation.BY_GENDER), gender).otherwise(0) + plural


def tails_by_table(endings: DataFrame) -> DataFrame:
    """of, tails array<struct<ending, grammar>>: the endings of each table."""
    return endings.groupBy(F.col("name").alias("of")).agg(F.collect_set(F.struct("ending", "grammar")).alias("tails"))


def resolved(lines: DataFrame, endings: DataFrame, alternations: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """line, normal, index, wd, stem, postfix, table, alternation (its place in the table, or null), cases, reject.

    ``ends``, if given, are what ``paradigms.normal_ends`` lists: the first that ends the word goes off.
    The tables go to the lines, a row for each table, so that lines are never shuffled.
    """
    cut = tables.russian_lines(lines)
    key = F.concat_ws(" ", "marks", "kind")
    known = cut.join(F.broadcast(pos_map(lines.sparkSession)), key == F.col("key"), "left")  # the keys are a fixed list
    known = known.withColumn("table", F.concat_ws(" ", "kind", "index"))
    code = G.pos(F.col("wd"))
    told = tails_by_table(endings)
    known = known.join(F.broadcast(told), F.col("table") == F.col("of"), "left")  # a row for each table, all of which were on the driver
    inflected = (code < notation.UNINFLECTED) & F.col("of").isNotNull()
    reject = F.when(F.col("wd").isNull(), "part of speech").when((code < notation.UNINFLECTED) & F.col("of").isNull() & (F.col("index") != "0"), "table")
    base = F.expr("substring(normal, 1, length(normal) - length(postfix))")
    known = known.withColumn("reject", reject).withColumn("inflected", inflected).withColumn("base", base)
    wd = F.col("wd").bitwiseOR(tables.flags(F.col("comment"), notation.FLAG_MARKS))
    mix = F.when(G.is_verb(F.col("wd")), verb_mix(F.col("index"))).otherwise(0)
    known = known.withColumn("grammar_of", normal_grammar(F.col("wd"), F.col("base")))

    # the longest ending of the normal form's grammar, or the first listed one
    verb = G.is_verb(F.col("wd"))
    if ends is None:
        mask = F.when(verb, 0x7FFF).otherwise(0xFFFF)
        fits = F.filter("tails", lambda x: F.col("base").endswith(x["ending"]) & (x["grammar"].bitwiseAND(mask) == F.col("grammar_of").bitwiseAND(mask)))
        off = F.array_max(F.transform(fits, lambda x: F.length(x["ending"])))
    else:
        tried = ends.groupBy(F.col("name").alias("of_ends"), "normal", "verb").agg(F.array_sort(F.collect_set(F.struct("steps", "ending"))).alias("tried")).withColumnRenamed("normal", "of_normal")
        known = known.join(F.broadcast(tried), (F.col("table") == F.col("of_ends")) & (F.col("grammar_of") == F.col("of_normal")) & (verb == F.col("verb")), "left")  # no more rows than the tables have endings
        off = F.length(F.get(F.filter("tried", lambda x: F.col("base").endswith(x["ending"])), F.lit(0))["ending"])
    known = known.withColumn("off", off)
    at = F.instr("base", "@")
    stem = F.when(at > 0, F.expr("substring(base, 1, instr(base, '@') - 1)")).when(F.col("inflected"), F.expr("substring(base, 1, length(base) - coalesce(off, 0))")).otherwise(F.col("base"))
    unstripped = F.col("inflected") & (at == 0) & F.col("off").isNull() & ~F.col("index").contains(":")
    known = known.withColumn("stem", stem).withColumn("reject", F.coalesce("reject", F.when(unstripped, "ending")))

    # the first alternation whose condition holds
    first = alternations.where("level = 1").groupBy(F.col("name").alias("of_name")).agg(F.array_sort(F.collect_set(F.struct("place", "condition", F.col("text").alias("gone")))).alias("listed"))
    known = known.join(F.broadcast(first), F.col("table") == F.col("of_name"), "left")  # a row for each table
    fits = lambda x: F.col("stem").endswith(x["gone"]) & F.when(verb, (x["condition"] == "о") | (x["condition"] == F.col("remark"))).otherwise(holds(x["condition"], F.col("stem")))
    chosen = F.when(F.col("reject").isNull() & F.col("inflected"), F.get(F.filter("listed", fits), F.lit(0)))
    known = known.withColumn("chosen", chosen).withColumn("gone", F.col("chosen.gone")).withColumn("alternation", F.col("chosen.place"))
    cases = F.when(code == notation.PREPOSITION, tables.case_scale(F.regexp_extract("index", notation.CASE_MARK + f"([{notation.CASE_LETTERS}]*)", 1), notation.CASE_LETTERS)).otherwise(0)
    return known.select(
        "line", "normal", "index",
        F.when(F.col("reject").isNull(), wd + F.when(F.col("alternation").isNotNull(), F.shiftleft(mix, 11)).otherwise(0)).alias("wd"),
        F.when(F.col("reject").isNull(), F.expr("substring(stem, 1, length(stem) - coalesce(length(gone), 0))")).alias("stem"),
        "postfix", F.when(F.col("inflected") & F.col("reject").isNull(), F.col("table")).alias("table"), "alternation", cases.alias("cases"), "reject",
    )


def first_letters(endings: DataFrame) -> DataFrame:
    """name, low, high: least and greatest first letter of a table's endings; an empty ending counts as the least."""
    letter = F.substring("ending", 1, 1)
    return endings.groupBy("name").agg(F.min(letter).alias("low"), F.max(letter).alias("high"))


def normal_forms(forms: DataFrame) -> DataFrame:
    """lexeme_id, normal, how: of forms(lexeme_id, wd, grammar, ending, form) the smallest text of the dictionary form.

    Where a verb or an adjective has none, its reflexive one stands for it; else the form
    with the least ending.
    """
    found = forms.groupBy("lexeme_id").agg(*[x.alias(name) for name, x in _candidates().items()])
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("back").isNotNull(), "reflexive").otherwise("first")
    return found.select("lexeme_id", F.coalesce("exact", "back", "first.form").alias("normal"), how.alias("how"))


def _candidates() -> dict[str, Column]:
    """What may be a lexeme's normal form, the first that there is: aggregates over its forms. The last has ending and form."""
    want = G.dictionary_form(F.col("wd"), F.col("grammar"))
    back = (G.is_verb(F.col("wd")) | G.is_adjective(F.col("wd"))) & (F.col("grammar") == want + G.REFLEXIVE)
    return {"exact": F.min(F.when(F.col("grammar") == want, F.col("form"))), "back": F.min(F.when(back, F.col("form"))), "first": F.min(F.struct("ending", "form"))}


def with_normal(forms: DataFrame) -> DataFrame:
    """Adds ``normal`` of ``normal_forms`` to each form; where forms are dealt by lexeme_id already, without another exchange."""
    exact, back, first = (x.over(Window.partitionBy("lexeme_id")) for x in _candidates().values())
    return forms.withColumn("normal", F.coalesce(exact, back, first["form"]))


def ordered(hits: DataFrame) -> DataFrame:
    """Adds ``place``: the lexemes of a token in the order of results.

    The longest stem comes first. Where ``hits`` has high and low, the greatest and least
    first letter of a lexeme's endings (see ``letter_range``), the greater high and then
    the lesser low come first, where it has postfix, the lesser one; then the number.
    """
    more = [F.desc("high")] * ("high" in hits.columns) + ["low"] * ("low" in hits.columns) + ["postfix"] * ("postfix" in hits.columns)
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("stem_len"), *more, "lexeme_id")))


def letter_range(forms: DataFrame) -> DataFrame:
    """lexeme_id, low, high: least and greatest first letter of a lexeme's endings; an empty ending counts as the least."""
    letter = F.substring("ending", 1, 1)
    return forms.groupBy("lexeme_id").agg(F.min(letter).alias("low"), F.max(letter).alias("high"))
