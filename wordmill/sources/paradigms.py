"""Russian articles to word forms: ending tables walked level by level, alternations on the way.

rows(name, place, ending, grammar, flags, next) are the entries of ending tables as they
stand in their files, ``place`` counting those of a table; an entry with a next table goes
on with each of that table's. Both walks are recursive queries over the rows.

``normal_ends`` lists what a normal form may end with, in the order in which endings are
tried: at a level, the entries of a table whose grammar has the level's bits of the normal
form's, in their order, each followed into its next table at the same level or a later
one; then the same table at the next level. Nouns have one level, the whole grammar word;
verbs have three: tense and person, then case, number and gender, then the reflexive
bit, where an entry counts without its next table. The first listed text that ends
the word goes off.

Both walks are taken once for a set of tables, and their results, as many rows as the tables
have endings, are kept as local tables: what is on the driver already, spelled out.

``forms`` builds the other way: every whole ending asks for its level of alternation, and
what the stem's alternation has at that level stands between stem and ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions import grammar as G
from wordmill.functions.text import with_capitals
from wordmill.sources import resolver, tables
from wordmill.sources.lexicon import PLAIN_FORM

# The bits of a verb's grammar word that count at each level; nouns have all at once.
VERB_LEVELS, NOUN_LEVELS = (0x007F, 0x7F80, 0x8000), (0xFFFF,)
# The kind of alternation of each part of speech; others have none.
MIX_KINDS = {
    1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, 8: 3, 9: 4, 10: 5, 11: 6, 12: 6, 13: 5, 14: 6, 15: 7, 16: 5, 17: 6, 18: 7,
    19: 5, 20: 6, 21: 5, 22: 6, 23: 5, 24: 5, 25: 8, 38: 6, 39: 6, 41: 6,
}
#: The last level, at which an entry counts without its next table.
LAST = 2


def table_rows(spark: SparkSession, parsed: list[tuple]) -> DataFrame:
    """The rows of ``tables.parse_tables`` with their places."""
    places: dict[str, int] = {}
    out = []
    for name, ending, grammar, then, flags in parsed:
        places[name] = places.get(name, -1) + 1
        out.append((name, places[name], ending, grammar, flags, then))
    return spark.createDataFrame(out, "name string, place int, ending string, grammar int, flags int, next string")


#: The grammar words that normal forms may have, and whether they are a verb's.
WANTED = [(g + plural, verb) for g, verb in ((G.INFINITIVE | G.REFLEXIVE, True), (1 << 9, False), ((1 << 9) + G.REFLEXIVE, False), (0, False)) for plural in (0, G.PLURAL)]

_settled: dict[tuple, DataFrame] = {}


def _once(what: str, rows: DataFrame, make) -> DataFrame:
    """The result of a walk over these rows as a local table, for a session."""
    key = what, rows.sparkSession.sparkContext.applicationId, rows.semanticHash()
    if key not in _settled:
        found = make()
        _settled[key] = rows.sparkSession.createDataFrame(found.collect(), found.schema)
    return _settled[key]


def whole_endings(rows: DataFrame) -> DataFrame:
    """name, ending, grammar, flags, steps of whole endings; ``steps`` sorts them as the tables list them. A table that goes on with itself is an error."""
    return _once("whole", rows, lambda: _whole_endings(rows))


def _whole_endings(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(
        """
        WITH RECURSIVE walk(name, ending, grammar, flags, next, steps) AS (
          SELECT name, ending, grammar, flags, next, array(place) FROM {rows}
          UNION ALL
          SELECT w.name, w.ending || r.ending, w.grammar | r.grammar, w.flags & r.flags, r.next, w.steps || array(r.place)
          FROM walk w JOIN {rows} r ON w.next = r.name
        )
        SELECT name, ending, grammar, flags, steps FROM walk WHERE next IS NULL
        """,
        rows=rows,
    )


def normal_ends(rows: DataFrame) -> DataFrame:
    """normal, verb, name, ending, steps: what normal forms may end with, to be tried in the order of ``steps``."""
    return _once("normal", rows, lambda: _normal_ends(rows))


def _normal_ends(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    levels = spark.createDataFrame([(True, i, m) for i, m in enumerate(VERB_LEVELS)] + [(False, i, m) for i, m in enumerate(NOUN_LEVELS)], "verb boolean, level int, mask int")
    tried = spark.createDataFrame(WANTED, "normal int, verb boolean").join(F.broadcast(levels), "verb")  # eight kinds of normal forms, three levels at most
    fits = "t.normal & t.mask = r.grammar & t.mask AND (t.normal & t.mask <> 0 OR t.mask = 65535)"
    return spark.sql(
        f"""
        WITH RECURSIVE walk(normal, verb, name, level, ending, next, steps) AS (
          SELECT t.normal, t.verb, r.name, t.level, r.ending, r.next, array(t.level * 1000000 + r.place)
          FROM {{tried}} t JOIN {{rows}} r ON {fits}
          UNION ALL
          SELECT w.normal, w.verb, w.name, t.level, w.ending || r.ending, r.next, w.steps || array(t.level * 1000000 + r.place)
          FROM walk w JOIN {{rows}} r ON w.next = r.name JOIN {{tried}} t ON t.normal = w.normal AND t.verb = w.verb AND t.level >= w.level AND {fits}
          WHERE w.level < {LAST}
        )
        SELECT DISTINCT normal, verb, name, ending, steps FROM walk WHERE next IS NULL OR level = {LAST}
        """,
        tried=tried,
        rows=rows,
    )


def stripped(words: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """keys, off: how many letters go off words(keys, table, base, normal, verb), for those that an ending fits."""
    on = (F.col("table") == F.col("name")) & (words["normal"] == ends["normal"]) & (words["verb"] == ends["verb"]) & F.col("base").endswith(F.col("ending"))
    return words.join(ends, on).groupBy(*keys).agg(F.min_by(F.length("ending"), "steps").alias("off"))


def mix_kind(wd: Column) -> Column:
    """The kind of alternation of a word, 0 if none."""
    kinds = F.create_map(*[F.lit(x) for kv in MIX_KINDS.items() for x in kv])
    return F.coalesce(F.element_at(kinds, G.pos(wd)), F.lit(0))


def resolved(lines: DataFrame, rows: DataFrame, alternations: DataFrame) -> DataFrame:
    """What ``resolver.resolved`` gives, the normal form's ending taken off by the walk."""
    return resolver.resolved(lines, whole_endings(rows).drop("steps"), alternations, normal_ends(rows))


def forms(stems: DataFrame, rows: DataFrame, alternations: DataFrame) -> DataFrame:
    """The columns of ``lexicon.expand``, wd and grammar, of stems(lexeme_id, stem, wd, table, alternation, postfix).

    A stem with an alternation has only forms whose level the alternation has; a word with
    a plural only has only plural forms. The lemma is the dictionary form.
    """
    ends = whole_endings(rows).select(F.col("name").alias("table"), "ending", "grammar", "flags")
    level = G.swap_level(mix_kind(F.col("wd")), F.col("wd"), F.col("grammar"), F.col("flags"))
    fits = (G.x_and(F.col("wd"), G.PLURAL_ONLY) == 0) | G.only_plural(F.col("grammar"))
    # dealt by lexeme before they grow: what follows needs a lexeme's forms together
    own = stems.where("lexeme_id is not null").repartition("lexeme_id")
    # both tables were on the driver, spelled out
    inflected = own.join(F.broadcast(ends), "table", "left").where(F.col("table").isNull() | (F.col("ending").isNotNull() & fits)).withColumn("level", level)
    told = inflected.join(F.broadcast(_texts(alternations)), ["table", "alternation", "level"], "left").where("table is null or alternation is null or text is not null")
    plain = F.col("table").isNull()
    ending = F.concat(F.coalesce("text", F.lit("")), F.coalesce("ending", F.lit("")))
    columns = ["lexeme_id", "wd", F.coalesce("grammar", F.lit(0)).alias("grammar"), F.coalesce("flags", F.lit(0)).alias("flags"), ending.alias("ending"), F.concat("stem", ending, "postfix").alias("form")]
    form_id = F.when(plain, PLAIN_FORM).otherwise(G.pack(F.col("wd"), F.col("grammar"), F.col("flags")).cast("int"))
    every = told.select(*columns, form_id.alias("form_id")).distinct()
    named = resolver.with_normal(every).withColumn("min_cap", G.min_capitals(F.col("wd")))
    return named.select(
        "lexeme_id", G.pos(F.col("wd")).cast("int").alias("pos"), "form_id", "ending", "form", "min_cap",
        with_capitals(F.col("normal"), F.col("min_cap")).alias("lemma"), with_capitals(F.col("form"), F.col("min_cap")).alias("surface"), "wd", "grammar",
    )


def _texts(alternations: DataFrame) -> DataFrame:
    """table, alternation, level, text."""
    return alternations.select(F.col("name").alias("table"), F.col("place").alias("alternation"), "level", "text").distinct()


def first_forms(stems: DataFrame, rows: DataFrame, alternations: DataFrame) -> DataFrame:
    """lexeme_id, form: the first ending that a stem's table lists, with the alternation of its level before it; none where the alternation lacks that level."""
    first = whole_endings(rows).groupBy(F.col("name").alias("table")).agg(F.min_by(F.struct("ending", "grammar", "flags"), "steps").alias("e")).select("table", "e.*")
    level = G.swap_level(mix_kind(F.col("wd")), F.col("wd"), F.col("grammar"), F.col("flags"))
    told = stems.join(F.broadcast(first), "table", "left").withColumn("level", level)
    built = told.join(F.broadcast(_texts(alternations)), ["table", "alternation", "level"], "left").where("table is null or alternation is null or text is not null")
    return built.select("lexeme_id", F.concat("stem", F.coalesce("text", F.lit("")), F.coalesce("ending", F.lit("")), "postfix").alias("form"))
