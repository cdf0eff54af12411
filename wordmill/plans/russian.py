"""Queries of the Russian chain, over articles that are made of the documents' words.

Every distinct word of 4 to 9 small Latin letters is written in Cyrillic letters, one for
one, and becomes an article of one of seven types, by its digest. The SQL states the forms
of each type as they were worked out by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions import text as T
from wordmill.operators import fuzzy, stats
from wordmill.plans.catalog import ORACLES, QUERIES, table
from wordmill.plans.compilers import _grammar
from wordmill.sources import derived, files, paradigms, stored, tables

LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшжыз"
#: For each type the rest of the normal form, and the rest of the line.
TYPES = (("ка", " # ж 3а"), ("ть", " # нсв 1а"), ("ый", " # п 1а"), ("", " # мо 1а"), ("сать", " # нсв 6а -ш- {превосх.}"), ("ой", " # п 1в"), ("ов", " # м 1с"))

ENDING_LINES = """
.table ж 3а
а, И
у, Вн
ой, Т
ек, число М|Р
.table мо 1а
0, И
а, Р
.table нсв 1а
0, инфинитив, личный
ю, время Н|лицо 1
.table личный
ть, инфинитив
ться, инфинитив|вф
.table нсв 6а
ть, инфинитив
у, время Н|лицо 1
ет, время Н|лицо 3
.table п 1а
ый, род м|И
ая, род ж|И
.table п 1в
ой, род м|И
ая, род ж|И
.table м 1с
0, И
а, Р
а, число М|И
""".strip().splitlines()
ALTERNATION_LINES = [".table ж 3а", "о, к, ч", ".table нсв 6а", "ш, са, ш, ш", "о, а, ''"]

# worked out by hand: type, what follows the word, form id, and what the lemma has after the word
FORMS = [
    (0, "ка", 0, "ка"), (0, "ку", 3, "ка"), (0, "кой", 5, "ка"), (0, "чек", 11, "ка"),
    (1, "ть", 0, "ть"), (1, "ться", 1, "ть"), (1, "ю", 18, "ть"),
    (2, "ый", 0, "ый"), (2, "ая", 8, "ый"),
    (3, "", 0, ""), (3, "а", 1, ""),
    (4, "сать", 0, "сать"), (4, "шу", 18, "сать"), (4, "шет", 26, "сать"),
    (5, "ой", 0, "ой"), (5, "ая", 8, "ой"),
    (6, "ов", 0, "ов"), (6, "ова", 1, "ов"), (6, "ова", 10, "ов"),
]

WORDS_SQL = f"""words as (
  select w, translate(w, '{LATIN}', '{CYRILLIC}') as word, cast(('0x' || left(md5(w), 15))::bigint % {len(TYPES)} as integer) as kind
  from (select distinct lower(unnest(regexp_extract_all(text, '\\p{{L}}+'))) as w from documents) where regexp_matches(w, '^[a-z]{{4,9}}$')),
kinds(kind, tail, rest) as (values {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TYPES))}),
built(kind, ending, form_id, lemma_tail) as (values {", ".join(map(str, FORMS))}),
articles as (select word || tail || rest as line, word, kind from words join kinds using (kind)),
russian as (select cast('0x' || left(md5(line), 15) as bigint) as lexeme_id, word || ending as form, form_id, word || lemma_tail as lemma from articles join built using (kind))"""


def in_cyrillic(word: Column) -> Column:
    return F.translate(word, LATIN, CYRILLIC)


def article_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lexeme_id, line."""
    words = T.tokens(table(spark, sf_dir, "documents"), least=4).select(F.lower("token").alias("w")).where(F.col("w").rlike("^[a-z]{4,9}$")).distinct()
    kind = derived.lexeme_id(F.col("w")) % len(TYPES)
    line = F.lit(None).cast("string")
    for i, (tail, rest) in enumerate(TYPES):
        line = F.when(kind == i, F.concat(in_cyrillic(F.col("w")), F.lit(tail + rest))).otherwise(line)
    return words.select(line.alias("line")).withColumn("lexeme_id", derived.lexeme_id(F.col("line")))


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stems of the articles, and the tables that they are built by.

    Lines and stems are written once: else the filters of lines would move below the count of words, to every occurrence. The tables are those of all queries of an application, and so are their walks.
    """
    rows, alternations = _tables(spark)
    lines = files.written(article_lines(spark, sf_dir))
    stems = paradigms.resolved(lines.select("line"), rows, alternations).where("reject is null")
    return files.written(stems.withColumn("lexeme_id", derived.lexeme_id(F.col("line")))), rows, alternations


_parsed: dict[str, tuple[DataFrame, DataFrame]] = {}


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Rows of the ending tables, and alternations, as one table each for an application."""
    session = spark.sparkContext.applicationId
    if session not in _parsed:
        rows = paradigms.table_rows(spark, tables.parse_tables(ENDING_LINES, _grammar))
        _parsed[session] = rows, spark.createDataFrame(tables.parse_alternations(ALTERNATION_LINES), "name string, place int, condition string, level int, text string")
    return _parsed[session]


def lexicon(spark: SparkSession, sf_dir: str) -> stored.Stored:
    """The forms of all articles, saved once for an application."""

    def make() -> DataFrame:
        return paradigms.forms(*resolved(spark, sf_dir)).drop("wd", "grammar")

    return stored.once(spark, f"russian {sf_dir}", make)


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, f"with {WORDS_SQL}{sql}"
        return f

    return add


@register("russian_article_stems", ' select line, word || case kind when 6 then \'ов\' else \'\' end as stem, kind in (0, 4) as alternates, \'\' as postfix from articles')
def russian_article_stems(spark, sf_dir):
    """What is left of every article's normal form after ending and alternation, by the walk through its tables."""
    stems, _, _ = resolved(spark, sf_dir)
    return stems.select("line", "stem", F.col("alternation").isNotNull().alias("alternates"), "postfix")


@register("russian_forms", " select lexeme_id, form, form_id, lemma from russian")
def russian_forms(spark, sf_dir):
    return lexicon(spark, sf_dir).forms.select("lexeme_id", "form", "form_id", "lemma")


@register("russian_first_forms", " select lexeme_id, lemma as form from russian where form_id = 0")
def russian_first_forms(spark, sf_dir):
    """The first form that each article's table lists, built from stem, alternation and ending."""
    return paradigms.first_forms(*resolved(spark, sf_dir))


@register("russian_round_trip", " select form, lexeme_id, lemma, string_agg(cast(form_id as varchar), ',' order by form_id) as grams from russian group by all")
def russian_round_trip(spark, sf_dir):
    """Every form that was built, looked up again: all lexemes that it may be of."""
    own = lexicon(spark, sf_dir)
    found = own.lemmatize(own.forms.select(F.col("form").alias("token")).distinct())
    nested = found.groupBy(F.col("folded").alias("form"), "lexeme_id", "lemma").agg(F.array_sort(F.collect_set("form_id")).alias("grams"))
    return nested.withColumn("grams", F.array_join(F.transform("grams", lambda x: x.cast("string")), ","))


@register(
    "russian_lemmatize",
    f", t as (select translate(lower(token), '{LATIN}', '{CYRILLIC}') as folded, count(*) as n from (select unnest(regexp_extract_all(text, '\\p{{L}}+')) as token from documents) group by 1) select folded, n, lexeme_id, lemma, form_id from t join russian on form = folded",
)
def russian_lemmatize(spark, sf_dir):
    """The documents' words in Cyrillic letters, looked up among the forms that were built; they are counted before they are written so."""
    # never null: else a filter would write every occurrence in Cyrillic letters to see that it is not null
    token = F.coalesce(in_cyrillic(F.col("folded")), F.lit(""))
    words = T.words(table(spark, sf_dir, "documents")).select(token.alias("token"), "n")
    return lexicon(spark, sf_dir).lemmatize(words, "n").select("folded", "n", "lexeme_id", "lemma", "form_id")


@register("russian_find_forms", " select r.form, o.lexeme_id, o.form as found from russian r join russian o using (lexeme_id) where r.form_id = 18 and o.form_id = 0")
def russian_find_forms(spark, sf_dir):
    """The infinitives of all present forms of the first person."""
    forms = lexicon(spark, sf_dir).forms
    own = forms.where("form_id = 18").select("form", "lexeme_id")
    return own.join(forms.where("form_id = 0").select("lexeme_id", F.col("form").alias("found")), "lexeme_id").select("form", "lexeme_id", "found")


# paradigms as classes name them: type, part of speech, stress on the ending, endings behind the common stem
CLASSES = [
    (0, 13, False, "0:ка,3:ку,5:кой,11:чек"), (1, 1, False, "0:ть,1:ться,18:ю"), (2, 25, False, "0:ый,8:ая"), (3, 8, False, "0:,1:а"),
    (4, 1, False, "0:сать,18:шу,26:шет"), (5, 25, True, "0:ой,8:ая"), (6, 7, True, "0:,1:а,10:а"),
]
CLASSES_SQL = f"""paradigms(kind, pos, accent, endings) as (values {", ".join(f"({k}, {p}, {str(a).lower()}, '{e}')" for k, p, a, e in CLASSES)}),
classes as (select kind, pos, accent, endings, cast(row_number() over (order by pos, endings, accent) as integer) as class_id from paradigms where kind in (select kind from articles)),
models as (select class_id, right(word || case kind when 6 then 'ов' else '' end, 2) as suffix, min(word || tail) as sample, count(*) as weight from articles join kinds using (kind) join classes using (kind) group by 1, 2)"""


def _trained(spark: SparkSession, sf_dir: str):
    """Each table is written once, since it is used by the next ones and by several joins."""
    extracted = files.written(fuzzy.extract(lexicon(spark, sf_dir).forms, accents=True))
    classed = files.written(fuzzy.classes(extracted))
    model, ending = files.written(fuzzy.models(extracted, classed)), fuzzy.endings(classed)
    return extracted, classed, model, ending, fuzzy.suffix_index(model, ending)


@register("russian_classes", f", {CLASSES_SQL} select class_id, pos, endings, accent, (select count(*) from articles a where a.kind = classes.kind) as n from classes")
def russian_classes(spark, sf_dir):
    """Paradigm classes of the forms that were built; those stressed on their endings stand apart."""
    return _trained(spark, sf_dir)[1].select("class_id", "pos", "endings", "accent", "n")


@register(
    "russian_models",
    f", {CLASSES_SQL}, wished as (select class_id, right(word || case kind when 6 then 'ов' else '' end, 2) as suffix, word || tail as sample, case ('0x' || left(md5(line), 15))::bigint % 3 when 0 then 0 when 1 then 2 else 1 end as rank from articles join kinds using (kind) join classes using (kind)) select class_id, suffix, arg_min(sample, (rank, sample)) as sample, count(*) as weight from wished group by class_id, suffix",
)
def russian_models(spark, sf_dir):
    """Stem ends and samples, a third of the articles marked as wanted and another as to be avoided."""
    extracted, classed, _, _, _ = _trained(spark, sf_dir)
    ids = extracted.select("lexeme_id")
    wish = F.when(F.col("lexeme_id") % 3 == 0, "+").when(F.col("lexeme_id") % 3 == 1, "-")
    return fuzzy.models(extracted, classed, ids.select("lexeme_id", wish.alias("wish")).where("wish is not null"))


@register(
    "russian_fuzzy",
    f""", {CLASSES_SQL},
fuzzy_endings as (select class_id, cast(split_part(e, ':', 1) as integer) as form_id, split_part(e, ':', 2) as ending from (select class_id, unnest(string_split(endings, ',')) as e from classes)),
suffix_index as (select suffix || ending as key, class_id, weight as power, form_id, length(ending) as ending_len from models join fuzzy_endings using (class_id)),
asked as (select translate(lower(token), '{LATIN}', '{CYRILLIC}') as word, case when token = lower(token) then 256 when length(token) > 1 and token = upper(left(token, 1)) || lower(token[2:]) then 257 else 258 end as scheme
  from (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as token from benchmark) where length(token) > 1 and (token = lower(token) or token = upper(token) or token[2:] = lower(token[2:]))),
hits as (select distinct word, class_id, length(word) - ending_len as stem_len, form_id, power, ending_len from (select distinct word from asked) join suffix_index on ends_with(word, key)),
grouped as (select word, class_id, stem_len, arg_min((power, ending_len), (form_id, power)) as f from hits group by all),
base as (select class_id, arg_min(ending, (form_id, ending)) as base from fuzzy_endings group by class_id),
weighed as (
  select word, class_id, cast(stem_len as integer) as stem_len, word[1:stem_len] || base as lemma,
    round((0.4::double * ([0.0, 0.05, 0.17, 0.55, 0.85, 0.97, 0.99, 0.99, 1.0][least(f[2], 8) + 1])::double + 0.3::double * ln(f[1]::double) / ln(9000.0::double)) * case when accent then 0.4::double else 1.0 end, 6) as weight
  from grouped join classes using (class_id) join base using (class_id))
select word, scheme, class_id, lemma, weight from (select *, row_number() over (partition by word, scheme order by weight desc, class_id, stem_len) as rank from (select distinct word, scheme from asked) join weighed using (word)) where rank = 1""",
)
def russian_fuzzy(spark, sf_dir):
    """The best hypothesis for each word of the benchmark in Cyrillic letters, by its capitalization; classes stressed on their endings weigh less."""
    _, classed, _, ending, index = _trained(spark, sf_dir)
    words = T.tokens(table(spark, sf_dir, "benchmark"), pattern="[A-Za-z]+", least=2).select(in_cyrillic(F.lower("token")).alias("word"), T.cap_scheme(F.col("token")).alias("scheme")).where(f"scheme <> {T.BAD_SCHEME}").distinct()
    none = spark.createDataFrame([], "pos int, form_id int, n double")  # no priors
    found = fuzzy.lemmatize(words, index, classed, ending, stats.pos_prior(none), stats.form_prior(none), capitals=True)
    return found.where("rank = 1").select("word", "scheme", "class_id", "lemma", "weight")
