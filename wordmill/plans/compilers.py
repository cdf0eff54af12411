"""Queries of the dictionary's compilers, packed grammar, class training and word games, with their SQL.

Where a reference result is known it stands in the SQL as values or as a rule of its
own, not as the engine's expression spelled again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordmill.functions import grammar as G
from wordmill.functions import text as T
from wordmill.operators import exact, fuzzy, letters, stats, training, wildcard
from wordmill.plans import catalog
from wordmill.plans.catalog import CLASSES, HYPOTHESES, distinct_tokens, register, table
from wordmill.sources import files, lexicon, notation, resolver, tables


def values(rows: list[tuple]) -> str:
    """Rows as SQL values."""
    show = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


# --- tokenizers -------------------------------------------------------------------------------------------------------
for _name, _pattern, _sql, _least in (
    ("tok_extended", T.EXTENDED, r"[A-Za-z\x{80}-\x{10FFFF}]+", 2),
    ("tok_cyrillic", T.CYRILLIC, "[А-Яа-яЁё][А-Яа-яЁё-]*", 4),
    ("tok_upper_half", T.UPPER_HALF, r"[A-\x{10FFFF}][A-\x{10FFFF}''-]*", 4),
    ("tok_russian", T.RUSSIAN, "[а-яА-ЯёЁ]+", 1),
):
    # the documents' letters shifted into the Cyrillic block, so that the patterns of that block have words to find
    _shift = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ')" if _name in ("tok_cyrillic", "tok_russian") else "text"

    @register(_name, f"with t as (select unnest(regexp_extract_all({_shift}, '{_sql}')) as token from documents) select token, count(*) as n from t where length(token) >= {_least} group by token", lex=False)
    def _tokens(spark, sf_dir, pattern=_pattern, least=_least, shift=_shift):
        docs = table(spark, sf_dir, "documents").select(F.expr(shift).alias("text"))
        return T.tokens(docs, pattern=pattern, least=least).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# --- sources ----------------------------------------------------------------------------------------------------------
@register("dict_load", "with f as (select case when pos in (2, 19) then 'verbs' else 'rest' end as file, lexeme_id from articles) select file, count(*) as n, min(lexeme_id) as low, max(lexeme_id) as high from f group by file")
def dict_load(spark, sf_dir):
    lines = lexicon.article_lines(spark)
    verb = F.col("line").rlike("\tV(_BE)?\t")
    files = lines.where(verb).withColumn("file", F.lit("verbs")).union(lines.where(~verb).withColumn("file", F.lit("rest")))
    both = files.join(lexicon.parse(files.select("line")).where("reject is null").select("line", "lexeme_id"), "line")
    return both.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("lexeme_id").alias("low"), F.max("lexeme_id").alias("high"))


ARTICLES = [
    ("рука # ж 3а",), ("сын # мо 1а//1б {исчисл.}",), ("дочка # жо 3*а",), ("чит=ать # нсв 1а",), ("умываться # нсв 1а",), ("ёлка # ж 3*а -разг- {разг.}",),
    ("сани мн. ж 2а",), ("он-то # мс 0 post:-то",), ("под # предл. ШП:ВТ",), ("новый # п 1а",), ("щец@ мн. м 5*а",), ("мыло # с 9а",), ("слово # ъъ 1а",), ("писать # нсв 6а -ш- {превосх.}",), ("короткая строка",),
]
LINE_SQL = f"""lines(line) as (values {values(ARTICLES)}),
cut as (select line, string_split(regexp_replace(translate(line, 'ёЁ', 'еЕ'), '\\s+', ' ', 'g'), ' ') as p from lines),
rows as (select line, replace(p[1], '=', '') as normal, p[2] as marks, p[3] as kind, unnest(string_split(p[4], '//')) as index, coalesce(array_to_string(p[5:], ' '), '') as comment from cut where len(p) >= 4)"""


@register(
    "russian_articles",
    f"""with {LINE_SQL}, keys(key, wd) as (values {values(notation.pos_rows())})
    select line, normal, marks, kind, index, regexp_extract(comment, '-([^-\\s]+)-', 1) as remark, regexp_extract(comment, 'post:\\s*(\\S+)', 1) as postfix, coalesce(wd, 0) as wd,
      cast((case when contains(comment, '{{превосх.}}') then 128 else 0 end) + (case when contains(comment, '{{исчисл.}}') then 256 else 0 end) + (case when contains(comment, '{{разг.}}') then 512 else 0 end) + (case when contains(comment, '{{руг.}}') then 1024 else 0 end) as integer) as flags,
      cast(list_sum([0] || list_transform(regexp_extract_all(regexp_extract(index, 'ШП:([ИРДВТП]*)', 1), '.'), lambda c: 1 << cast(position(c in 'ИРДВТП') - 1 as integer))) as integer) as cases
    from rows left join keys on key = marks || ' ' || kind""",
    lex=False,
)
def russian_articles(spark, sf_dir):
    rows = tables.russian_lines(spark.createDataFrame(ARTICLES, "line string"))
    told = rows.join(F.broadcast(resolver.pos_map(spark)), F.concat_ws(" ", "marks", "kind") == F.col("key"), "left")
    return told.select(
        "line", "normal", "marks", "kind", "index", "remark", "postfix", F.coalesce("wd", F.lit(0)).alias("wd"),
        tables.flags(F.col("comment"), notation.FLAG_MARKS).alias("flags"),
        tables.case_scale(F.regexp_extract("index", "ШП:([ИРДВТП]*)", 1), notation.CASE_LETTERS).alias("cases"),
    )


@register("pos_map", f"select * from (values {values(notation.pos_rows())}) t(key, wd)", lex=False)
def pos_map(spark, sf_dir):
    return resolver.pos_map(spark)


ENDING_LINES = """
.table ж 3а
{
а, И
у, Вн
ой, Т
}
.table ж 3*а
{
а, И
у, Вн
}
.table жо 3*а
{
а, И
у, Во
}
.table мо 1а
{
0, И
а, Р
}
.table нсв 1а
{
0, инфинитив, личный
ю, время Н|лицо 1
}
.table личный
{
ть, инфинитив
ться, инфинитив|вф
}
.table нсв 6а
{
ть, инфинитив
у, время Н|лицо 1
}
.table ж 2а
{
и, число М|И
}
.table п 1а
{
ый, род м|И
ая, род ж|И
}
.table м 5*а
{
, число М|Р
}
""".strip().splitlines()


def _grammar(text: str, before: int) -> int:
    g = 0
    for token in text.split("|"):
        keep, put, _, _ = notation.RUSSIAN_TOKENS[token.strip()]
        g = g & keep | put
    return g


def _endings(spark):
    lines = [x for x in ENDING_LINES if x]
    return tables.expand_endings(tables.ending_rows(spark, tables.parse_tables(lines, _grammar)))


# grammar words worked out by hand: case << 12, plural 2048, genders 512 to 1536, tense 1 and 4, person 8, reflexive 32768
ENDINGS = [
    ("ж 3а", "а", 0), ("ж 3а", "у", 12288), ("ж 3а", "ой", 16384), ("ж 3*а", "а", 0), ("ж 3*а", "у", 12288), ("жо 3*а", "а", 0), ("жо 3*а", "у", 12288),
    ("мо 1а", "", 0), ("мо 1а", "а", 4096), ("нсв 1а", "ть", 1), ("нсв 1а", "ться", 32769), ("нсв 1а", "ю", 12), ("личный", "ть", 1), ("личный", "ться", 32769),
    ("нсв 6а", "ть", 1), ("нсв 6а", "у", 12), ("ж 2а", "и", 2048), ("п 1а", "ый", 512), ("п 1а", "ая", 1024), ("м 5*а", "", 6144),
]


@register("ending_tables", f"select name, ending, cast(grammar as integer) as grammar, 255 as flags from (values {values(ENDINGS)}) t(name, ending, grammar)", lex=False)
def ending_tables(spark, sf_dir):
    return _endings(spark)


@register(
    "equal_tables",
    f"with e(name, ending, grammar) as (values {values(ENDINGS)}), b as (select name, string_agg(ending || ':' || grammar, ',' order by ending, grammar) as body from e group by name) select name, min(name) over (partition by body) as stands_for from b",
    lex=False,
)
def equal_tables(spark, sf_dir):
    return tables.equal_tables(_endings(spark))


@register("first_letters", f"with e(name, ending, grammar) as (values {values(ENDINGS)}) select name, min(left(ending, 1)) as low, max(left(ending, 1)) as high from e group by name", lex=False)
def first_letters(spark, sf_dir):
    return resolver.first_letters(_endings(spark))


ALTERNATION_LINES = [".table ж 3а", "{", "о, к, ч", "}", ".table ж 3*а", "{", "ь к, ек, к", "о, к, ок", "}", ".table жо 3*а", "{", "ш, чк, чек", "}", ".table нсв 6а", "{", "ш, са, ш, ш", "о, а, ''", "}"]
ALTERNATIONS = [
    ("ж 3а", 0, "о", 1, "к"), ("ж 3а", 0, "о", 2, "ч"), ("ж 3*а", 0, "ь", 1, "к"), ("ж 3*а", 0, "ь", 2, "ек"), ("ж 3*а", 0, "ь", 3, "к"), ("ж 3*а", 1, "о", 1, "к"), ("ж 3*а", 1, "о", 2, "ок"),
    ("жо 3*а", 0, "ш", 1, "чк"), ("жо 3*а", 0, "ш", 2, "чек"), ("нсв 6а", 0, "ш", 1, "са"), ("нсв 6а", 0, "ш", 2, "ш"), ("нсв 6а", 0, "ш", 3, "ш"), ("нсв 6а", 1, "о", 1, "а"), ("нсв 6а", 1, "о", 2, ""),
]


def _alternations(spark):
    return spark.createDataFrame(tables.parse_alternations(ALTERNATION_LINES), "name string, place int, condition string, level int, text string")


@register(
    "alternation_tables",
    f"select name, place, condition, text, cast(sum(1 << (level - 1)) as integer) as mask from (values {values(ALTERNATIONS)}) t(name, place, condition, level, text) group by name, place, condition, text",
    lex=False,
)
def alternation_tables(spark, sf_dir):
    rows = _alternations(spark).withColumn("key", F.struct("name", "place", "condition"))
    return tables.alternations(rows.select(F.col("key").alias("name"), "level", "text")).select("name.name", "name.place", "name.condition", "text", "mask")


# worked out by hand from the articles above: stems, the place of their alternation, prepositions' cases, and why lines are rejected
STEMS = [
    ("рука # ж 3а", "3а", 13, "ру", "", "ж 3а", 0, 0, None), ("сын # мо 1а//1б {исчисл.}", "1а", 8 + 256, "сын", "", "мо 1а", None, 0, None), ("сын # мо 1а//1б {исчисл.}", "1б", None, None, "", None, None, 0, "table"),
    ("дочка # жо 3*а", "3*а", 14, "до", "", "жо 3*а", 0, 0, None), ("чит=ать # нсв 1а", "1а", 1, "чита", "", "нсв 1а", None, 0, None), ("умываться # нсв 1а", "1а", 1, "умыва", "", "нсв 1а", None, 0, None),
    ("ёлка # ж 3*а -разг- {разг.}", "3*а", 13 + 512, "ел", "", "ж 3*а", 1, 0, None), ("сани мн. ж 2а", "2а", 13 + 64, "сан", "", "ж 2а", None, 0, None), ("он-то # мс 0 post:-то", "0", 29, "он", "-то", None, None, 0, None),
    ("под # предл. ШП:ВТ", "ШП:ВТ", 51, "под", "", None, None, 24, None), ("новый # п 1а", "1а", 25, "нов", "", "п 1а", None, 0, None), ("щец@ мн. м 5*а", "5*а", 7 + 64, "щец", "", "м 5*а", None, 0, None),
    ("мыло # с 9а", "9а", None, None, "", None, None, 0, "table"), ("слово # ъъ 1а", "1а", None, None, "", None, None, 0, "part of speech"), ("писать # нсв 6а -ш- {превосх.}", "6а", 1 + 128 + 2048, "пи", "", "нсв 6а", 0, 0, None),
]


@register(
    "russian_stems",
    f"select line, index, cast(wd as integer) as wd, stem, postfix, \"table\", cast(alternation as integer) as alternation, cast(cases as integer) as cases, reject from (values {values(STEMS)}) t(line, index, wd, stem, postfix, \"table\", alternation, cases, reject)",
    lex=False,
)
def russian_stems(spark, sf_dir):
    found = resolver.resolved(spark.createDataFrame(ARTICLES, "line string"), _endings(spark), _alternations(spark))
    return found.select("line", "index", "wd", "stem", "postfix", "table", "alternation", "cases", "reject")


EXPRESSIONS = ["И", "время Н|лицо 1", "инфинитив|вф", "род ж|Вн", "число М|Р", "время П|страд|род с|Т", "кф", "ср", "нр", "Во|соед", "деепр", "время П|действ|вф|число М|П2"]
# worked out by hand: grammar and flags after all tokens, from 0 on
TOKEN_RESULTS = [
    ("И", 0, 3), ("время Н|лицо 1", 4 + 8, 3), ("инфинитив|вф", 1 + 32768, 3), ("род ж|Вн", 1024 + 12288, 2), ("число М|Р", 2048 + 4096, 3), ("время П|страд|род с|Т", 5 + 64 + 1536 + 16384, 3),
    ("кф", 256, 3), ("ср", 128, 3), ("нр", 64, 3), ("Во|соед", 12288, 9), ("деепр", 96, 3), ("время П|действ|вф|число М|П2", 5 + 32 + 2048 + 28672, 3),
]
UKRAINIAN_RESULTS = [("inf", 1, 3), ("prs|face 3|plur", 4 + 2048, 3), ("pst|fem", 5 + 1024, 3), ("З", 24576, 3), ("Во", 12288, 1), ("prs|act|msc|Р", 4 + 32 + 512 + 4096, 3)]

for _name, _vocabulary, _rows in (("grammar_tokens", notation.RUSSIAN_TOKENS, TOKEN_RESULTS), ("grammar_tokens_ukrainian", notation.UKRAINIAN_TOKENS, UKRAINIAN_RESULTS)):

    @register(_name, f"select expression, cast(grammar as integer) as grammar, cast(flags as integer) as flags from (values {values(_rows)}) t(expression, grammar, flags)", lex=False)
    def _tokens_of(spark, sf_dir, vocabulary=_vocabulary, rows=_rows):
        return tables.token_values(spark, vocabulary, [r[0] for r in rows])


@register(
    "class_json",
    f"with {CLASSES} select class_id, pos, n as rate, (select count(*) from models m where m.class_id = c.class_id) as n_models, (select sum(weight) from models m where m.class_id = c.class_id)::bigint as weight, cast(len(string_split(endings, ',')) as bigint) as n_endings from classes c",
)
def class_json(spark, sf_dir):
    """Written as JSON and read again."""
    _, classed, model, ending, _ = catalog._fuzzy(spark)
    back = tables.class_json(classed, model, ending).select(F.from_json("json", tables.CLASS_JSON).alias("c"))
    weight = F.aggregate("c.models", F.lit(0).cast("long"), lambda a, m: a + m["weight"])
    return back.select(F.col("c.index").alias("class_id"), F.col("c.partSp").alias("pos"), F.col("c.rate").alias("rate"), F.size("c.models").cast("long").alias("n_models"), weight.alias("weight"), F.size("c.inflex").cast("long").alias("n_endings"))


MARKS = [("stem|a N LID:12 +++",), ("--- other LID:13",), ("no mark LID:14",), ("+++ without number",), ("twice --- LID:015",)]


@register("sample_marks", f"with l(line) as (values {values(MARKS)}) select cast(regexp_extract(line, 'LID:([0-9]+)', 1) as bigint) as lexeme_id, case when contains(line, '+++') then '+' else '-' end as wish from l where regexp_matches(line, 'LID:[0-9]+') and regexp_matches(line, '\\+\\+\\+|---')", lex=False)
def sample_marks(spark, sf_dir):
    return tables.preferred(spark.createDataFrame(MARKS, "line string"))


# fixed values: bytes of a word in each page, from the pages' published tables
PAGE_BYTES = [("Ёж - Ok!", "windows-1251", "A8E6202D204F6B21"), ("Ёж - Ok!", "koi8", "B3D6202D204F6B21"), ("Ёж - Ok!", "dos", "F0A6202D204F6B21"), ("Ёж - Ok!", "iso-8859-5", "A1D6202D204F6B21"), ("Ёж - Ok!", "mac", "DDE6202D204F6B21"), ("Ёж - Ok!", "utf8", "D081D0B6202D204F6B21"), ("中ж", "win", "3FE6")]


@register("code_pages", f"select text, page, bytes, case when bytes = '3FE6' then '?ж' else text end as back from (values {values(PAGE_BYTES)}) t(text, page, bytes)", lex=False)
def code_pages(spark, sf_dir):
    out = None
    for text, page, _ in PAGE_BYTES:
        data = lexicon.to_code_page(F.col("text"), page)
        row = spark.createDataFrame([(text, page)], "text string, page string").select("text", "page", F.hex(data).alias("bytes"), lexicon.from_code_page(data, page).alias("back"))
        out = row if out is None else out.union(row)
    return out


# --- packed grammar ---------------------------------------------------------------------------------------------------
@register(
    "gram_predicates",
    """with w as (select cast(unnest(range(64)) as integer) as wd), g as (select unnest([0, 1, 2048, 37, 69, 98, 32801, 768]) as gr)
    select wd, gr, wd between 1 and 6 as verb, wd in (25, 26, 27, 28, 34, 36, 42) as adjective, gr in (37, 69, 98, 32801) as participle, gr = 2048 as plural, case when wd between 37 and 47 then 1 when wd = 59 then 2 else 0 end as min_cap,
      cast(case when wd between 1 and 6 then case when gr in (37, 69) then gr + 512 when gr = 98 then 610 when gr = 32801 then 545 else 1 end when wd in (25, 26, 27, 28, 34, 36, 42) then 512 else 0 end as integer) as dictionary from w, g""",
    lex=False,
)
def gram_predicates(spark, sf_dir):
    base = spark.range(512).select((F.col("id") % 64).cast("int").alias("wd"), F.get(F.array(*map(F.lit, [0, 1, 2048, 37, 69, 98, 32801, 768])), F.floor(F.col("id") / 64).cast("int")).alias("gr"))
    wd, gr = F.col("wd"), F.col("gr")
    return base.select(
        "wd", "gr", G.is_verb(wd).alias("verb"), G.is_adjective(wd).alias("adjective"), G.is_participle(gr).alias("participle"), G.only_plural(gr).alias("plural"),
        G.min_capitals(wd).alias("min_cap"), G.dictionary_form(wd, gr, keep_participles=True).cast("int").alias("dictionary"),
    )


# form ids as blocks: participles are 3 genders and a plural times 7 cases and a short form
BLOCKS_SQL = """decl as (select g * 8 + s as n, case when g = 3 then 2048 else (g + 1) * 512 end + case s when 7 then 256 when 0 then 0 when 1 then 4096 when 2 then 8192 when 3 then 12288 when 4 then 12288 when 5 then 16384 when 6 then 20480 end as gr,
  case s when 3 then 2 when 4 then 1 else 3 end as fl from (select unnest(range(4)) as g), (select unnest(range(8)) as s)),
parts as (select n, gr + 32 as gr, fl from decl union all select n + 32, gr + 32 + 32768, fl from decl union all select n + 64, gr + 64, fl from decl union all select 96, 96, 3 union all select 97, 96 + 32768, 3),
persons as (select (p - 1) * 4 + r * 2 + m as n, p * 8 + r * 32768 + m * 2048 as gr from (select unnest([1, 2, 3]) as p), (select unnest([0, 1]) as r), (select unnest([0, 1]) as m)),
verb as (select r as f, 1 + r * 32768 as gr, 3 as fl from (select unnest([0, 1]) as r) union all select 2 + r * 2 + m, 2 + r * 32768 + m * 2048, 3 from (select unnest([0, 1]) as r), (select unnest([0, 1]) as m)
  union all select 6 + n, gr + 3, 3 from persons union all select 18 + n, gr + 4, 3 from persons union all select 30 + n, gr + 4, fl from parts
  union all select 128 + r * 4 + g, 5 + r * 32768 + case when g = 3 then 2048 else (g + 1) * 512 end, 3 from (select unnest([0, 1]) as r), (select unnest(range(4)) as g) union all select 136 + n, gr + 5, fl from parts),
adjective as (select n as f, gr, fl from decl union all select n + 32, gr + 32768, fl from decl union all select 64, 128, 3 union all select 65, 64, 3),
noun as (select c + 10 * p as f, case when c < 4 then c else c - 1 end * 4096 + p * 2048 as gr, case c when 3 then 2 when 4 then 1 else 3 end as fl from (select unnest(range(9)) as c), (select unnest([0, 1]) as p) where c + 10 * p <= 17),
every as (select 1 as wd, * from verb union all select 25, * from adjective union all select 7, * from noun union all select 71, * from noun where f >= 10)"""


@register("form_ids", f"with {BLOCKS_SQL} select cast(wd as integer) as wd, cast(f as integer) as form_id, cast(gr as integer) as gr, cast(fl as integer) as flags from every", lex=False)
def form_ids(spark, sf_dir):
    """Every form id that a verb, an adjective, a noun and a plural-only noun have, unpacked."""
    base = spark.range(4 * 256).select(F.get(F.array(*map(F.lit, [1, 25, 7, 71])), F.floor(F.col("id") / 256).cast("int")).alias("wd"), (F.col("id") % 256).cast("int").alias("form_id"))
    out = base.select("wd", "form_id", G.unpack(F.col("wd"), F.col("form_id")).cast("int").alias("gr"), G.unpack_flags(F.col("wd"), F.col("form_id")).cast("int").alias("flags"))
    return out.where("gr >= 0")


@register("form_ids_packed", f"with {BLOCKS_SQL} select cast(wd as integer) as wd, cast(f as integer) as form_id, cast(f as integer) as packed from every", lex=False)
def form_ids_packed(spark, sf_dir):
    """Unpacked form ids, packed again: each comes back."""
    own = form_ids(spark, sf_dir)
    return own.select("wd", "form_id", G.pack(F.col("wd"), F.col("gr"), F.col("flags")).cast("int").alias("packed"))


@register(
    "coarse_pos",
    """select cast(w as integer) as wd, cast(case when w <= 6 and w >= 1 then 1 when w in (7, 8, 9) then 7 when w in (13, 14, 15) then 13 when w in (16, 17, 18) then 16 when w in (25, 26) then 25 when w in (38, 39, 40, 41, 42, 44, 45, 46) then w else 0 end as integer) as coarse
    from (select unnest(range(64)) as w)""",
    lex=False,
)
def coarse_pos(spark, sf_dir):
    return spark.range(64).select(F.col("id").cast("int").alias("wd"), G.coarse_pos(F.col("id").cast("int")).cast("int").alias("coarse"))


@register("fold_future", "select cast(f as integer) as form_id, cast(case when f >= 6 and f <= 17 then f + 12 else f end as integer) as folded from (select unnest(range(256)) as f)", lex=False)
def fold_future(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("form_id"), G.fold_future(F.col("id").cast("int")).cast("int").alias("folded"))


@register(
    "swap_level_verb",
    """with g as (select s, t, k, p, n from (select unnest(range(4)) as s), (select unnest(range(1, 6)) as t), (select unnest(range(4)) as k), (select unnest(range(4)) as p), (select unnest(range(2)) as n))
    select cast(1 + 2048 * s as integer) as wd, cast(t + 32 * k + 8 * p + 2048 * n as integer) as gr,
      cast(case s when 0 then case when t = 5 and k = 2 then 3 when p = 1 and n = 0 then 2 else 1 end when 1 then case when t = 5 and k = 2 then 3 when t in (1, 5) then 1 else 2 end when 2 then case when t in (3, 4) then 2 else 1 end else 1 end as integer) as level from g""",
    lex=False,
)
def swap_level_verb(spark, sf_dir):
    i = F.col("id")
    base = spark.range(640).select((1 + 2048 * (i % 4)).cast("int").alias("wd"), (F.floor(i / 4) % 5 + 1 + 32 * (F.floor(i / 20) % 4) + 8 * (F.floor(i / 80) % 4) + 2048 * F.floor(i / 320)).cast("int").alias("gr"))
    return base.select("wd", "gr", G.swap_level(F.lit(1), F.col("wd"), F.col("gr"), F.lit(0)).cast("int").alias("level"))


@register("swap_level_adjective", "select cast(gr as integer) as gr, cast(case gr when 128 then 3 when 768 then 2 else 1 end as integer) as level from (select unnest([0, 128, 768, 512, 2304, 4096]) as gr)", lex=False)
def swap_level_adjective(spark, sf_dir):
    base = spark.createDataFrame([(x,) for x in (0, 128, 768, 512, 2304, 4096)], "gr int")
    return base.select("gr", G.swap_level(F.lit(G.ADJECTIVE_MIX), F.lit(25), F.col("gr"), F.lit(0)).cast("int").alias("level"))


@register(
    "swap_level_ukrainian",
    """with g as (select k, v, c, p, f from (select unnest(range(2, 8)) as k), (select unnest(range(2)) as v), (select unnest(range(8)) as c), (select unnest(range(2)) as p), (select unnest([1, 2]) as f)),
    e as (select *, case k when 4 then case when f = 1 then 3 else 2 end when 7 then case when f = 1 then 6 else 5 end else k end as u, c || case when p = 1 then 'p' else 's' end as x from g)
    select cast(k as integer) as kind, cast(v as integer) as variant, cast(c * 4096 + p * 2048 as integer) as gr, cast(f as integer) as flags,
      cast(case when u = 2 and v = 0 then case when x in ('0s', '3s') then 1 else 2 end when u = 2 then case when x = '5s' then 2 else 1 end when u = 3 and v = 0 then case when x = '0s' then 1 else 2 end when u = 3 then case when x = '6s' then 2 else 1 end
        when v = 0 then case when x = '1p' or (u = 6 and x = '3p') then 2 when x in ('2s', '5s') then 3 else 1 end else case when x = '4s' then 2 when x in ('1s', '3s', '6s') then 1 else 3 end end as integer) as level from e""",
    lex=False,
)
def swap_level_ukrainian(spark, sf_dir):
    i = F.col("id")
    base = spark.range(384).select(
        (i % 6 + 2).cast("int").alias("kind"), (F.floor(i / 6) % 2).cast("int").alias("variant"), (F.floor(i / 12) % 8 * 4096 + F.floor(i / 96) % 2 * 2048).cast("int").alias("gr"), (F.floor(i / 192) + 1).cast("int").alias("flags")
    )
    return base.select("*", G.swap_level_ukrainian(F.col("kind"), F.col("variant"), F.lit(0), F.col("gr"), F.col("flags")).cast("int").alias("level"))


@register("plural_filter", "select cast(x as integer) as gr from (select unnest([0, 2048, 4096, 6144, 2056]) as x) where x in (2048, 6144, 2056)", lex=False)
def plural_filter(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in (0, 2048, 4096, 6144, 2056)], "gr int").where(G.only_plural(F.col("gr")))


# --- lookups ----------------------------------------------------------------------------------------------------------
@register("lemmatize_ids", "select distinct token, lexeme_id from tokens join forms on folded = form", tok=True)
def lemmatize_ids(spark, sf_dir):
    return exact.lemmatize(distinct_tokens(spark, sf_dir), catalog.forms_of(spark), lemma=False, grammar=False)


@register("lemmatize_first", "select token, arg_min(lexeme_id, (lexeme_id, form_id)) as lexeme_id, arg_min(form_id, (lexeme_id, form_id)) as form_id from tokens join forms on folded = form group by token", tok=True)
def lemmatize_first(spark, sf_dir):
    return exact.first_only(distinct_tokens(spark, sf_dir), catalog.forms_of(spark))


@register(
    "lemmatize_json",
    """with h as (select distinct token, lexeme_id, lemma, pos, form_id from tokens join forms on folded = form), n as (select token, lexeme_id, min(lemma) as lemma, min(pos) as pos, string_agg(form_id, ',' order by form_id) as ids from h group by token, lexeme_id)
    select token, '[' || string_agg('{"lemma":"' || lemma || '","lexid":' || lexeme_id || ',"psp":' || pos || ',"forms":[' || ids || ']}', ',' order by lexeme_id) || ']' as json from n group by token""",
    tok=True,
)
def lemmatize_json(spark, sf_dir):
    return exact.as_json(distinct_tokens(spark, sf_dir), catalog.forms_of(spark))


@register(
    "lexeme_order",
    """with h as (select distinct token, lexeme_id, length(form) - length(ending) as stem_len from tokens join forms on folded = form), m as (select token, lexeme_id, cast(max(stem_len) as integer) as stem_len from h group by all)
    select token, lexeme_id, stem_len, cast(row_number() over (partition by token order by stem_len desc, lexeme_id) as integer) as place from m""",
    tok=True,
)
def lexeme_order(spark, sf_dir):
    hits = exact.hits(distinct_tokens(spark, sf_dir), catalog.forms_of(spark)).groupBy("token", "lexeme_id").agg(F.max(F.length("form") - F.length("ending")).alias("stem_len"))
    return resolver.ordered(hits)


@register("find_match_grouped", "with m as (select distinct lexeme_id, form, form_id from forms where form like 's%') select lexeme_id, string_agg(form || ':' || form_id, ',' order by form, form_id) as matches from m group by lexeme_id")
def find_match_grouped(spark, sf_dir):
    return wildcard.grouped_matches(catalog.forms_of(spark), "s*").select("lexeme_id", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["form"], m["form_id"].cast("string"))), ",").alias("matches"))


@register("find_match_callback", "with m as (select distinct lexeme_id, form, form_id from forms where form like '%ed') select lexeme_id, cast(count(*) as bigint) as n, min(form) as first from m group by lexeme_id")
def find_match_callback(spark, sf_dir):
    return wildcard.each_match(catalog.forms_of(spark), "*ed", lambda lexeme, found: [(lexeme, len(found), found[0][0])], "lexeme_id long, n long, first string")


@register("nouns_by_mask", "select distinct lexeme_id, form, form_id from forms where pos = 1 and form_id in (0, 255) and form like '____' and contains(form, 'e') and not regexp_matches(form, '[xz]')")
def nouns_by_mask(spark, sf_dir):
    return wildcard.nouns_by_mask(catalog.forms_of(spark), "????", "e", "xz", pos=(1, 1))


@register("without_range", "select lexeme_id, lemma from lexemes where lexeme_id < 2000 or lexeme_id > 4999")
def without_range(spark, sf_dir):
    return exact.without_range(lexicon.lexemes(catalog.forms_of(spark)).select("lexeme_id", "lemma"), 2000, 4999)


@register("wildcard_kind", "select * from (values ('*', true, true), ('***', true, true), ('a*', true, false), ('a?b', true, false), ('abc', false, false), ('', false, false)) t(pattern, wildcard, asterisk)", lex=False)
def wildcard_kind(spark, sf_dir):
    return spark.createDataFrame([(p, wildcard.is_wildcard(p), wildcard.is_asterisk(p)) for p in ("*", "***", "a*", "a?b", "abc", "")], "pattern string, wildcard boolean, asterisk boolean")


@register("normal_form_min", "with f as (select lexeme_id, form, form_id, min(form_id) over (partition by lexeme_id) as low from forms) select lexeme_id, min(form) as normal from f where form_id = low group by lexeme_id")
def normal_form_min(spark, sf_dir):
    own = catalog.forms_of(spark).groupBy("lexeme_id", "form_id").agg(F.min("form").alias("form"))
    return own.groupBy("lexeme_id").agg(F.min(F.struct("form_id", "form"))["form"].alias("normal"))


NORMAL_ROWS = [
    (1, 1, 1, "ть", "читать"), (1, 1, 12, "ю", "читаю"), (2, 1, 32769, "ться", "смеяться"), (2, 1, 32780, "юсь", "смеюсь"), (3, 25, 512, "ой", "молодой"), (3, 25, 512, "ый", "младый"), (3, 25, 1024, "ая", "молодая"),
    (4, 13, 4096, "и", "щеки"), (4, 13, 8192, "е", "щеке"), (5, 77, 2048, "и", "сани"), (5, 77, 0, "я", "саня"), (6, 42, 33280, "ся", "злойся"),
]


@register("normal_forms", "select * from (values (1, 'читать', 'exact'), (2, 'смеяться', 'reflexive'), (3, 'младый', 'exact'), (4, 'щеке', 'first'), (5, 'сани', 'exact'), (6, 'злойся', 'reflexive')) t(lexeme_id, normal, how)", lex=False)
def normal_forms(spark, sf_dir):
    return resolver.normal_forms(spark.createDataFrame(NORMAL_ROWS, "lexeme_id int, wd int, grammar int, ending string, form string"))


# --- classes and statistics -------------------------------------------------------------------------------------------
@register("models_ranked", f"with {CLASSES} select class_id, suffix, sample, weight, cast(row_number() over (partition by class_id order by weight desc, sample) as integer) as place from models")
def models_ranked(spark, sf_dir):
    return fuzzy.ranked_models(catalog._fuzzy(spark)[2]).select("class_id", "suffix", "sample", "weight", "place")


@register("suffix_reversed", f"with {CLASSES} select distinct reverse(key) as key, class_id, power, form_id from suffix_index")
def suffix_reversed(spark, sf_dir):
    return catalog._fuzzy(spark)[4].select(F.reverse("key").alias("key"), "class_id", "power", "form_id").distinct()


@register(
    "fuzzy_wildcard",
    f"""with {CLASSES}, tri as (select distinct unnest(list_transform(range(1, length(form) - 1), lambda i: form[i:i + 2])) as t from forms where length(form) >= 3)
    select distinct key, class_id, form_id, power from suffix_index where ends_with(key, 'king') or key in ('ing', 'ng') and (key = 'ing' and 'kin' in (select t from tri) or key = 'ng' and 'ing' in (select t from tri)) or key = 'g'""",
)
def fuzzy_wildcard(spark, sf_dir):
    return fuzzy.wild_probe(catalog._fuzzy(spark)[4], "w*king", fuzzy.trigraphs(catalog.forms_of(spark)))


@register("trigraphs", "select distinct unnest(list_transform(range(1, length(form) - 1), lambda i: form[i:i + 2])) as tri from forms where length(form) >= 3")
def trigraphs(spark, sf_dir):
    return fuzzy.trigraphs(catalog.forms_of(spark))


@register(
    "stematize_json",
    f"""with {HYPOTHESES}, ids_of as (select word, class_id, stem_len, string_agg(distinct form_id, ',' order by form_id) as ids from hits group by all)
    select ranked.word, '{{"lemma":"' || lemma || '","class":' || ranked.class_id || ',"psp":' || c.pos || ',"forms":[' || ids || ']}}' as json
    from ranked join ids_of g on g.word = ranked.word and g.class_id = ranked.class_id and g.stem_len = ranked.stem_len join classes c on c.class_id = ranked.class_id where rank = 1""",
    tok=True,
)
def stematize_json(spark, sf_dir):
    top = catalog._hypotheses(spark, sf_dir).where("rank = 1")
    return top.select("word", F.to_json(F.struct("lemma", F.col("class_id").alias("class"), F.col("pos").alias("psp"), F.col("grams").alias("forms"))).alias("json"))


@register("fuzzy_part_of_speech", f"with {CLASSES}, ids as (select unnest(range(0, 60)) as class_id) select cast(ids.class_id as integer) as class_id, cast(coalesce(pos, 0) as integer) as pos from ids left join classes on classes.class_id = ids.class_id")
def fuzzy_part_of_speech(spark, sf_dir):
    ids = spark.range(60).select(F.col("id").cast("int").alias("class_id"))
    return ids.join(catalog._fuzzy(spark)[1].select("class_id", "pos"), "class_id", "left").select("class_id", F.coalesce("pos", F.lit(0)).alias("pos"))


PARADIGMS = [
    (1, 7, 0, "нож"), (1, 7, 5, "ножом"), (2, 7, 0, "бой"), (2, 7, 1, "боя"), (3, 7, 0, "город"), (3, 7, 10, "города"), (4, 7, 0, "стол"), (4, 7, 10, "столы"), (5, 25, 0, "молодой"), (6, 25, 0, "новый"), (7, 13, 0, "рука"), (8, 7, 5, "мячом"), (9, 7, 0, "юг-восток"), (9, 7, 1, "юга-востока"), (2, 7, 10, "бои"),
]
PARADIGM_SCHEMA = "lexeme_id int, pos int, form_id int, form string"


@register("class_accents", "select * from (values (1, true), (2, true), (3, true), (4, false), (5, true), (6, false), (7, false), (8, true), (9, false)) t(lexeme_id, accent)", lex=False)
def class_accents(spark, sf_dir):
    return training.accents(spark.createDataFrame(PARADIGMS, PARADIGM_SCHEMA))


@register("form_selection", f"with p(lexeme_id, pos, form_id, form) as (values {values(PARADIGMS)}) select lexeme_id, pos, form_id, form from p where lexeme_id in (2, 3, 4, 1, 5, 6, 7) and form_id in (0, 10)", lex=False)
def form_selection(spark, sf_dir):
    return training.selected(spark.createDataFrame(PARADIGMS, PARADIGM_SCHEMA), [0], [10])


@register("form_expansion", f"with p(lexeme_id, pos, form_id, form) as (values {values(PARADIGMS)}) select lexeme_id, pos, form_id, form from p union all select lexeme_id, pos, case form_id when 0 then 3 when 1 then 4 else 13 end, form from p where form_id in (0, 1, 10)", lex=False)
def form_expansion(spark, sf_dir):
    return training.expanded(spark.createDataFrame(PARADIGMS, PARADIGM_SCHEMA), {0: 3, 1: 4, 10: 13})


COUNT_LINES = [("7, 0:10, 1:5, 255:3",), ("13, 0:2",), ("7, 1:7,10:1",)]


@register("frequency_lines", "select cast(pos as integer) as pos, cast(form_id as integer) as form_id, cast(n as bigint) as n from (values (7, 0, 10), (7, 1, 12), (7, 10, 1), (13, 0, 2)) t(pos, form_id, n)", lex=False)
def frequency_lines(spark, sf_dir):
    return training.counted_lines(spark.createDataFrame(COUNT_LINES, "line string"))


SAMPLES_SQL = f"""{HYPOTHESES}, lemmas as (select distinct form as word, lower(lemma) as lemma, 1 as hit from forms), every as (select folded as word, cast(sum(n) as bigint) as n from tokens group by folded),
known_words as (select distinct folded as word from tokens where folded in (select form from forms) and length(folded) between 2 and 47),
kcut as (select word, right(word, cast(size as bigint)) as key from (select word, unnest(range(2, least(length(word), (select max(length(key)) from suffix_index)) + 1)) as size from known_words)),
khits as (select word, class_id, length(word) - ending_len as stem_len, form_id, power, ending_len from kcut join suffix_index using (key)),
kgrouped as (select word, class_id, stem_len, arg_min((form_id, power, ending_len), (form_id, power)) as f from khits group by all),
samples as (select e.n, f[2]::bigint as power, cast(f[3] as integer) as ending_len, k.word, k.class_id, coalesce(hit, 0) as hit
  from kgrouped k join base using (class_id) join every e on e.word = k.word left join lemmas l on l.word = k.word and l.lemma = k.word[1:k.stem_len] || base)"""


def _samples(spark, sf_dir):
    forms = catalog.forms_of(spark)
    words = T.words(table(spark, sf_dir, "documents"))
    known = words.where(F.col("size").between(2, T.LONGEST)).join(lexicon.for_join(forms.select("form").distinct()), F.col("folded") == F.col("form"), "left_semi")
    _, classed, _, ending, index = catalog._fuzzy(spark)
    return stats.samples(words, fuzzy.candidates(known.select(F.col("folded").alias("word")), index, ending), forms)


@register("training_samples", f"with {SAMPLES_SQL} select word, n, class_id, power, ending_len, hit from samples", tok=True)
def training_samples(spark, sf_dir):
    return _samples(spark, sf_dir).select("word", "n", "class_id", "power", "ending_len", "hit")


@register("training_loss", f"with {SAMPLES_SQL} select round(sum(n * case when hit = 1 then 1.0::double - r else r end), 4) as loss from (select *, power::double / 100 * (0.3::double + 0.7::double * sin(atan(0.5::double * (ending_len - 1.0::double)))) as r from samples)", tok=True)
def training_loss(spark, sf_dir):
    own = _samples(spark, sf_dir).withColumn("power", F.col("power") / 100.0)
    rank = training.rank_of(F.col("power"), F.col("ending_len"), [0.3, 0.5, 1.0])
    return own.agg(F.round(F.sum(F.col("n") * F.when(F.col("hit") == 1, 1.0 - rank).otherwise(rank)), 4).alias("loss"))


@register("tuned_weights")
def tuned_weights(spark, sf_dir):
    """Weights found by descent from a fixed start, the loss there and the loss before."""
    # written once: every step of the descent is an aggregation over these rows
    own = files.written(_samples(spark, sf_dir).withColumn("power", F.col("power") / 100.0).groupBy("power", "ending_len", "hit").agg(F.sum("n").alias("n")))
    start = [0.3, 0.5, 1.0]
    weights, after = training.tuned(own, start, [0.0, 0.0, 0.0], [1.0, 5.0, 10.0])
    before = training.loss(own, [start])[0]
    return spark.createDataFrame([(*weights, before, after)], "floor double, steep double, middle double, before double, after double")


@register("id_pages", "with p as (select distinct lexeme_id, 1 + (lexeme_id - 1) // 32768 as page from articles) select page, count(*) as used, cast(32768 - count(*) as bigint) as free from p group by page")
def id_pages(spark, sf_dir):
    found = stats.id_pages(lexicon.articles(lexicon.article_lines(spark)).select("lexeme_id"))
    return found.select(F.col("page").cast("long").alias("page"), F.col("used").cast("long").alias("used"), F.col("free").cast("long").alias("free"))


# --- marks and games --------------------------------------------------------------------------------------------------
@register("marked_stems", "select form, left(form, length(form) - length(ending)) || '|' || right(form, length(ending)) as marked from (select distinct form, ending, pos from forms where form_id = 2)")
def marked_stems(spark, sf_dir):
    own = catalog.forms_of(spark).where("form_id = 2").select("form", "ending", "pos").distinct()
    return own.select("form", T.marked_stem(F.col("form"), F.length("form") - F.length("ending")).alias("marked"))


@register("fold_yo", "select * from (values ('ёлка Ёж', 'елка Еж'), ('мёд', 'мед'), ('plain', 'plain')) t(word, folded)", lex=False)
def fold_yo(spark, sf_dir):
    rows = spark.createDataFrame([("ёлка Ёж",), ("мёд",), ("plain",)], "word string")
    return rows.select("word", T.fold_yo(F.col("word")).alias("folded"))


@register(
    "letter_marks",
    """with w as (select distinct form from forms where form like '_____' and regexp_matches(form, '^[a-z]+$'))
    select form, array_to_string(list_transform(range(1, 6), lambda i: case when 'order'[i] = form[i] then form[i] when contains('order', form[i]) then '+' else '-' end), '') as marks from w""",
)
def letter_marks(spark, sf_dir):
    own = catalog.forms_of(spark).where(F.col("form").rlike("^[a-z]{5}$")).select("form").distinct()
    return own.select("form", letters.marked(F.lit("order"), F.col("form")).alias("marks"))


@register(
    "letter_narrowed",
    "select distinct form from forms where regexp_matches(form, '^[a-z]{5}$') and form[4:5] = 'er' and form[1] <> 'e' and not regexp_matches(form, '[nt]') and form[2] <> 'n'",
)
def letter_narrowed(spark, sf_dir):
    own = catalog.forms_of(spark).where(F.col("form").rlike("^[a-z]{5}$")).select("form").distinct()
    return letters.narrowed(own, [("enter", "+--er")])


@register(
    "letter_best",
    """with w as (select distinct form from forms where regexp_matches(form, '^[a-z]{5}$')), c as (select form, unnest(regexp_extract_all(form, '.')) as l from w), r as (select l, count(*) as n from c group by l),
    s as (select form, cast(sum(n) as bigint) as rank from (select distinct form, l from c) join r using (l) group by form) select form, rank from s order by rank desc, form limit 1""",
)
def letter_best(spark, sf_dir):
    own = catalog.forms_of(spark).where(F.col("form").rlike("^[a-z]{5}$")).select("form").distinct()
    return letters.best(own, letters.letter_ranks(own))


@register(
    "letter_picked",
    """with c as (select unnest(regexp_extract_all(form, '.')) as l from (select distinct form from forms where regexp_matches(form, '^[a-z]{5}$'))), r as (select l, count(*) as n from c group by l), s as (select l, sum(n) over (order by l) as up, sum(n) over () as total from r),
    d as (select cast(i as bigint) as draw, i / 20.0::double as u from (select unnest(range(20)) as i)) select draw, min(l) as letter from d, s where floor(u * total) <= up group by draw""",
)
def letter_picked(spark, sf_dir):
    own = catalog.forms_of(spark).where(F.col("form").rlike("^[a-z]{5}$")).select("form").distinct()
    return letters.picked(letters.letter_ranks(own), spark.range(20).select(F.col("id").alias("draw"), (F.col("id") / 20.0).alias("u")))
