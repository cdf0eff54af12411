"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions import grammar as G
from wordmill.functions import text as T
from wordmill.operators import exact, fuzzy, stats, wildcard
from wordmill.sources import files, lexicon, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_chosen: ContextVar[DataFrame | None] = ContextVar("forms of the queries that are being planned", default=None)


def forms_of(spark: SparkSession) -> DataFrame:
    """The word forms that a query is planned over: those of ``planned_over``, else the lexicon that comes with the package."""
    chosen = _chosen.get()
    return lexicon.forms(spark) if chosen is None else chosen


@contextmanager
def planned_over(forms: DataFrame):
    """Queries planned within look up these forms."""
    token = _chosen.set(forms)
    try:
        yield
    finally:
        _chosen.reset(token)


def _articles_sql() -> str:
    """The lexicon's lines as VALUES, cut into fields by SQL."""
    rows = ", ".join("('" + x.replace("'", "''") + "')" for x in words.lines())
    tags = " ".join(f"when '{k}' then {v}" for k, v in words.POS.items())
    return f"""
lines(line) as (values {rows}),
articles as (
  select cast(regexp_extract(line, '[\\t ]LID:([0-9]+)', 1) as bigint) as lexeme_id, split_part(split_part(line, chr(9), 1), '|', 1) as raw,
    case when contains(line, '|') then regexp_extract(split_part(line, chr(9), 1), '^[^|]*\\|(.*)$', 1) end as spec,
    case split_part(line, chr(9), 2) {tags} end as pos, lower(regexp_extract(line, 'post:\\s*(\\S+)', 1)) as postfix
  from lines),
stems as (
  select lexeme_id, pos, spec, postfix, lower(raw) as stem, case when regexp_matches(raw, '^[A-Z][A-Z]') then 2 when regexp_matches(raw, '^[A-Z][a-z]') then 1 else 0 end as min_cap
  from articles),
slots as (select *, unnest(range(len(string_split(spec, '|')))) as form_id from stems where spec is not null),
alternatives as (select *, unnest(string_split(string_split(spec, '|')[form_id + 1], '/')) as e from slots),
plain_forms as (
  select lexeme_id, pos, cast(form_id as integer) as form_id, case when e = '0' then '' else lower(e) end as ending, min_cap, stem, postfix from alternatives where e <> '-'
  union all select lexeme_id, pos, 255, '', min_cap, stem, postfix from stems where spec is null),
built as (select distinct lexeme_id, pos, form_id, ending, stem || ending || postfix as form, min_cap from plain_forms),
based as (select *, first_value(form) over (partition by lexeme_id order by form_id, ending) as base from built),
forms as (
  select lexeme_id, pos, form_id, ending, form, min_cap, {_capitals_sql("base")} as lemma, {_capitals_sql("form")} as surface from based)"""


def _capitals_sql(x: str) -> str:
    part = "upper(p[1:1]) || p[2:]"
    return f"case min_cap when 2 then upper({x}) when 1 then array_to_string(list_transform(string_split({x}, '-'), lambda p, i: case when len(string_split({x}, '-')) = 3 and i = 2 then p else {part} end), '-') else {x} end"


LEX = _articles_sql()
LEXEMES = "lexemes as (select lexeme_id, min(pos) as pos, min(lemma) as lemma, min(min_cap) as min_cap, cast(count(distinct form) as integer) as n_forms from forms group by lexeme_id)"
TOKENS = "tokens as (select lang, token, lower(token) as folded, count(*) as n from (select lang, unnest(regexp_extract_all(text, '\\p{L}+')) as token from documents) where length(token) >= 1 group by all)"
SCHEME = r"""case when regexp_matches(w, '^\p{Ll}+$') then 256 when regexp_matches(w, '^\p{Lu}\p{Ll}+$') then 257 when regexp_matches(w, '^\p{Lu}+$') then 258 else 255 end"""


def register(name: str, sql: str | None = None, lex: bool = True, tok: bool = False):
    """Registers a query; its SQL is a SELECT over the common tables ``forms`` and ``tokens``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            tables = ([LEX, LEXEMES] if lex else []) + ([TOKENS] if tok else [])
            body = sql.strip()
            if tables:
                head, body = (body[5:].strip(), "") if body.lower().startswith("with ") else ("", body)
                ORACLES[name] = "with " + ",\n".join(tables) + (",\n" + head if head else "\n" + body)
            else:
                ORACLES[name] = body
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents", text: str = "text", by: tuple[str, ...] = ("lang",)) -> DataFrame:
    return T.counted(T.tokens(table(spark, sf_dir, name), text, least=1, keep=by), *by)


def distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.counted(T.tokens(table(spark, sf_dir, "documents"), least=1))


@register("lex_expand", "select lexeme_id, pos, form_id, ending, form, surface, lemma, min_cap from forms")
def lex_expand(spark, sf_dir):
    return forms_of(spark).select("lexeme_id", "pos", "form_id", "ending", "form", "surface", "lemma", "min_cap")


@register("lex_lexemes", "select * from lexemes")
def lex_lexemes(spark, sf_dir):
    return lexicon.lexemes(forms_of(spark))


@register("tok_tokens", "select lang, token, folded, n from tokens where length(token) >= 2", lex=False, tok=True)
def tok_tokens(spark, sf_dir):
    return T.counted(T.tokens(table(spark, sf_dir, "documents"), keep=("lang",)), "lang").select("lang", "token", "folded", "n")


@register(
    "tok_capscheme",
    r"""with words as (select distinct unnest(regexp_extract_all(o_orderpriority || ' ' || o_orderstatus, '\p{L}[\p{L}''-]*')) as token from orders
      union select distinct unnest(regexp_extract_all(text, '\p{L}[\p{L}''-]*')) from conversations union select distinct unnest(regexp_extract_all(text, '\p{L}[\p{L}''-]*')) from documents),
    parts as (select token, string_split(token, '-') as p from words),
    coded as (select token, len(p) as n, list_transform(p, lambda x, i: case when regexp_matches(x, '^[\p{Ll}'',]+$') then 0 when regexp_matches(x, '^\p{Lu}[\p{Ll}'',]+$') then 1 when regexp_matches(x, '^\p{Lu}+$') then 2 when x = '' and i = len(p) and i > 1 then 0 else -1 end) as c from parts),
    schemed as (select token, cast(case when list_min(c) < 0 then 255 else n * 256 + (cast(list_sum(list_transform(c, lambda x, i: case when i <= 4 then x << cast(2 * (i - 1) as integer) else 0 end)) as integer)) end as integer) as scheme from coded)
    select token, scheme, scheme in (256, 512, 768, 513, 769, 257, 517, 785, 258, 522, 810) as ok0, scheme in (257, 517, 785, 258, 522, 810) as ok1, scheme in (258, 522, 810) as ok2 from schemed""",
    lex=False,
)
def tok_capscheme(spark, sf_dir):
    one = table(spark, sf_dir, "orders").select(F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    texts = one.union(table(spark, sf_dir, "conversations").select("text")).union(table(spark, sf_dir, "documents").select("text"))
    found = T.tokens(texts, pattern=T.HYPHENATED, least=1).distinct()
    scheme = T.cap_scheme(F.col("token"))
    return found.select("token", scheme.alias("scheme"), *[T.cap_allowed(scheme, F.lit(k)).alias(f"ok{k}") for k in (0, 1, 2)])


KNOWN = "select distinct form from forms"


@register("lex_coverage", f"select lang, cast(sum(n) as bigint) as total, cast(sum(case when folded in ({KNOWN}) then n else 0 end) as bigint) as known from tokens group by lang", tok=True)
def lex_coverage(spark, sf_dir):
    return stats.coverage(corpus(spark, sf_dir), forms_of(spark), "lang")


for _name, _text in (("conversations", "text"), ("benchmark", "text"), ("pages", "html")):
    _source = f"regexp_replace(regexp_replace({_text}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')" if _name == "pages" else _text

    @register(
        f"lex_coverage_{_name}",
        f"with t as (select lower(unnest(regexp_extract_all({_source}, '\\p{{L}}+'))) as w from {_name}) select '{_name}' as source, count(*) as total, cast(count(*) filter (w in ({KNOWN})) as bigint) as known from t",
    )
    def _coverage(spark, sf_dir, name=_name, text=_text):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("source"), (T.without_tags(F.col(text)) if name == "pages" else F.col(text)).alias("text"))
        return stats.coverage(T.counted(T.tokens(rows, least=1, keep=("source",)), "source"), forms_of(spark), "source")


@register("check_word", f"select distinct token from tokens where folded in ({KNOWN})", tok=True)
def check_word(spark, sf_dir):
    return exact.check_word(distinct_tokens(spark, sf_dir), forms_of(spark)).select("token")


@register("unknown_words", f"select token, cast(sum(n) as bigint) as n from tokens where folded not in ({KNOWN}) group by token", tok=True)
def unknown_words(spark, sf_dir):
    return exact.unknown_words(distinct_tokens(spark, sf_dir), forms_of(spark)).select("token", "n")


@register(
    "check_word_casesens",
    f"with w as (select distinct token as w, folded from tokens) select distinct w as token from w join forms on folded = form where ({SCHEME}) in (258) or (({SCHEME}) = 257 and min_cap <= 1) or (({SCHEME}) = 256 and min_cap = 0)",
    tok=True,
)
def check_word_casesens(spark, sf_dir):
    return exact.check_word(distinct_tokens(spark, sf_dir), forms_of(spark), ignore_case=False).select("token")


@register("lemmatize", "select distinct token, lexeme_id, lemma, pos, form_id from tokens join forms on folded = form", tok=True)
def lemmatize(spark, sf_dir):
    return exact.lemmatize(distinct_tokens(spark, sf_dir), forms_of(spark))


@register(
    "lemmatize_nested",
    "with h as (select distinct token, lexeme_id, lemma, pos, form_id from tokens join forms on folded = form) select token, lexeme_id, min(lemma) as lemma, min(pos) as pos, string_agg(cast(form_id as varchar), ',' order by form_id) as grams from h group by token, lexeme_id",
    tok=True,
)
def lemmatize_nested(spark, sf_dir):
    return exact.lemmatize_nested(distinct_tokens(spark, sf_dir), forms_of(spark)).withColumn("grams", F.array_join(F.transform("grams", lambda x: x.cast("string")), ","))


@register("part_of_speech", "with ids as (select unnest(range(0, 9000)) as lexeme_id) select lexeme_id, coalesce(pos, 0) as pos from ids left join lexemes using (lexeme_id)")
def part_of_speech(spark, sf_dir):
    return exact.part_of_speech(spark.range(9000).withColumnRenamed("id", "lexeme_id"), lexicon.lexemes(forms_of(spark)))


@register("build_form", "select lexeme_id, form_id, surface from forms where form_id = 1")
def build_form(spark, sf_dir):
    return exact.build_form(forms_of(spark), form_id=1)


@register("build_paradigm", "select lexeme_id, form_id, surface from forms where lexeme_id = 100")
def build_paradigm(spark, sf_dir):
    return exact.build_form(forms_of(spark), lexeme_id=100)


@register("find_forms", "with own as (select distinct token, lexeme_id from tokens join forms on folded = form) select token, own.lexeme_id, surface from own join forms f on f.lexeme_id = own.lexeme_id and f.form_id = 3", tok=True)
def find_forms(spark, sf_dir):
    return exact.find_forms(distinct_tokens(spark, sf_dir), forms_of(spark), 3).select("token", "lexeme_id", "surface")


@register("lemma_frequency", "with own as (select distinct form, lexeme_id, lemma from forms) select lexeme_id, lemma, cast(sum(n) as bigint) as n from tokens join own on folded = form group by all", tok=True)
def lemma_frequency(spark, sf_dir):
    return stats.frequency(distinct_tokens(spark, sf_dir), forms_of(spark))


@register("pos_by_lang", "with own as (select distinct form, pos from forms) select lang, pos, cast(sum(n) as bigint) as n from tokens join own on folded = form group by all", tok=True)
def pos_by_lang(spark, sf_dir):
    return stats.pos_by(corpus(spark, sf_dir), forms_of(spark), "lang")


for _name, _pattern in (("prefix", "s*"), ("infix", "a*ed"), ("single", "?a?"), ("double", "w**k*")):

    @register(f"find_match_{_name}", f"select distinct lexeme_id, form, form_id from forms where form like '{wildcard.like(_pattern)}' escape '\\'")
    def _match(spark, sf_dir, pattern=_pattern):
        return wildcard.find_match(forms_of(spark), pattern)


@register("find_first_match", "select lexeme_id, min(form) as form from forms where form like 'p%' group by lexeme_id")
def find_first_match(spark, sf_dir):
    return wildcard.first_matches(forms_of(spark), "p*")


@register("enumerate_words", "select distinct lexeme_id, form_id from forms where form like '%ing'")
def enumerate_words(spark, sf_dir):
    return wildcard.enumerate_words(forms_of(spark), "*ing")


@register("next_chars", "select distinct substr(form, 3, 1) as next_char from forms where form like 'pa_%'")
def next_chars(spark, sf_dir):
    return wildcard.next_chars(forms_of(spark), "pa")


@register("letters_filter", "select distinct lexeme_id, form, form_id from forms where form like '_____' and contains(form, 'e') and not regexp_matches(form, '[so]')")
def letters_filter(spark, sf_dir):
    return wildcard.letters_filter(forms_of(spark), "?????", "e", "so")


CLASSES = """g as (select lexeme_id, pos, min(form) as low, max(form) as high, min(lemma) as sample from forms where form_id <> 255 group by lexeme_id, pos),
s as (select lexeme_id, pos, sample, low[1:coalesce(list_max(list_filter(range(1, least(len(low), len(high)) + 1), lambda i: low[1:i] = high[1:i])), 0)] as stem from g),
ends as (select s.lexeme_id, s.pos, s.stem, s.sample, string_agg(form_id || ':' || form[len(stem) + 1:], ',' order by form_id, form) as endings from s join (select distinct lexeme_id, form_id, form from forms where form_id <> 255) f using (lexeme_id) where len(stem) >= 2 group by all),
extracted as (select lexeme_id, pos, stem, right(stem, 2) as suffix, endings, sample from ends),
classes as (select cast(dense_rank() over (order by pos, endings) as integer) as class_id, pos, endings, count(*) as n from extracted group by pos, endings),
models as (select class_id, suffix, min(sample) as sample, count(*) as weight from extracted join classes using (pos, endings) group by class_id, suffix),
fuzzy_endings as (select class_id, cast(split_part(e, ':', 1) as integer) as form_id, split_part(e, ':', 2) as ending from (select class_id, unnest(string_split(endings, ',')) as e from classes)),
suffix_index as (select suffix || ending as key, class_id, weight as power, form_id, cast(length(ending) as integer) as ending_len from models join fuzzy_endings using (class_id))"""


_tables: dict = {}


def _fuzzy(spark):
    """Tables as large as the lexicon at most; made and cached once a session, since hypotheses read each several times."""
    forms = forms_of(spark)
    session = spark.sparkContext.applicationId, forms.semanticHash()
    if session not in _tables:
        for gone in [k for k in _tables if k[0] != session[0]]:
            del _tables[gone]
        extracted = fuzzy.extract(forms).cache()
        classed = fuzzy.classes(extracted).cache()
        model, ending = fuzzy.models(extracted, classed).cache(), fuzzy.endings(classed).cache()
        _tables[session] = extracted, classed, model, ending, fuzzy.suffix_index(model, ending).cache()
    return _tables[session]


@register("class_extract", f"with {CLASSES} select lexeme_id, pos, stem, suffix, endings, sample from extracted")
def class_extract(spark, sf_dir):
    return _fuzzy(spark)[0]


@register("class_productivity", f"with {CLASSES} select class_id, pos, endings, n from classes")
def class_productivity(spark, sf_dir):
    return _fuzzy(spark)[1]


@register("class_cut95", f"with {CLASSES}, r as (select class_id, pos, endings, n, cast(sum(n) over (order by n desc, class_id rows unbounded preceding) as bigint) as running, sum(n) over () as total from classes) select class_id, pos, endings, n, running from r where running <= 0.95 * total")
def class_cut95(spark, sf_dir):
    return fuzzy.covered(_fuzzy(spark)[1])


@register("fuzzy_models", f"with {CLASSES} select class_id, suffix, sample, weight from models")
def fuzzy_models(spark, sf_dir):
    return _fuzzy(spark)[2].select("class_id", "suffix", "sample", "weight")


@register("suffix_index", f"with {CLASSES} select key, class_id, power, form_id, ending_len from suffix_index")
def suffix_index(spark, sf_dir):
    return _fuzzy(spark)[4]


MERGED = """pairs as (select distinct class_id, form_id, ending from fuzzy_endings join classes using (class_id) where pos = 1),
own as (select *, count(*) over (partition by class_id) as size from pairs),
covers as (select b.class_id as absorbed, a.class_id as larger from own b join own a using (form_id, ending) where a.class_id <> b.class_id group by b.class_id, a.class_id having count(*) = any_value(b.size)),
merged as (select absorbed, min(larger) as larger from covers where larger not in (select absorbed from covers) group by absorbed)"""


@register("class_merge", f"with {CLASSES}, {MERGED} select absorbed, larger as \"into\" from merged")
def class_merge(spark, sf_dir):
    return fuzzy.merge_classes(_fuzzy(spark)[1])


@register(
    "class_merge_models",
    f"with {CLASSES}, {MERGED} select coalesce(larger, class_id) as class_id, suffix, min(sample) as sample, cast(sum(weight) as bigint) as weight from models left join merged on absorbed = class_id group by all",
)
def class_merge_models(spark, sf_dir):
    return fuzzy.merged_models(_fuzzy(spark)[2], fuzzy.merge_classes(_fuzzy(spark)[1]))


PRIORS = """readings as (select form, lexeme_id, pos, list(distinct form_id) as ids from forms group by form, lexeme_id, pos),
nl as (select form, count(*) as lexemes from readings group by form),
shares as (select form, pos, unnest(ids) as form_id, 1.0::double / lexemes / len(ids) as share from readings join nl using (form)),
found as (select pos, form_id, sum(n * share) as n from (select folded, sum(n) as n from tokens group by folded) join shares on folded = form group by pos, form_id),
pos_prior as (select pos, round(sum(n) / sum(sum(n)) over (), 6) as share from found group by pos),
form_prior as (select pos, form_id, round(n / sum(n) over (partition by pos), 6) as share from found)"""


@register("pos_prior", f"with {PRIORS} select pos, share from pos_prior", tok=True)
def pos_prior(spark, sf_dir):
    return stats.pos_prior(stats.fractions(distinct_tokens(spark, sf_dir), forms_of(spark)))


@register("form_prior", f"with {PRIORS} select pos, form_id, share from form_prior", tok=True)
def form_prior(spark, sf_dir):
    return stats.form_prior(stats.fractions(distinct_tokens(spark, sf_dir), forms_of(spark)))


HYPOTHESES = f"""{CLASSES}, {PRIORS},
unknown as (select distinct folded as word from tokens where folded not in ({KNOWN}) and length(folded) between 2 and 47),
cut as (select word, right(word, cast(size as bigint)) as key from (select word, unnest(range(2, least(length(word), (select max(length(key)) from suffix_index)) + 1)) as size from unknown)),
hits as (select word, class_id, length(word) - ending_len as stem_len, form_id, power, ending_len from cut join suffix_index using (key)),
grouped as (select word, class_id, stem_len, arg_min((form_id, power, ending_len), (form_id, power)) as f from hits group by all),
base as (select class_id, arg_min(ending, (form_id, ending)) as base from fuzzy_endings group by class_id),
weighed as (
  select word, class_id, cast(stem_len as integer) as stem_len, word[1:stem_len] || base as lemma,
    round(0.4::double * ([0.0, 0.05, 0.17, 0.55, 0.85, 0.97, 0.99, 0.99, 1.0][least(f[3], 8) + 1])::double + 0.3::double * ln(f[2]::double) / ln(9000.0::double) + 0.2::double * coalesce(p.share, 0) + 0.1::double * coalesce(fp.share, 0), 6) as weight
  from grouped join classes using (class_id) join base using (class_id) left join pos_prior p on p.pos = classes.pos left join form_prior fp on fp.pos = classes.pos and fp.form_id = f[1]),
ranked as (select *, cast(row_number() over (partition by word order by weight desc, class_id, stem_len) as integer) as rank from weighed)"""


def _hypotheses(spark, sf_dir, words=None):
    """Hypotheses for unknown words. One written table of distinct words gives the priors and the words; both priors are of one written table."""
    forms = forms_of(spark)
    words = files.written(T.words(table(spark, sf_dir, "documents"))) if words is None else words
    _, classed, _, ending, index = _fuzzy(spark)
    found = files.written(stats.fractions(words, forms))
    unknown = words.where(F.col("size").between(2, T.LONGEST)).join(lexicon.for_join(forms.select("form").distinct()), F.col("folded") == F.col("form"), "left_anti")
    return fuzzy.lemmatize(unknown.select(F.col("folded").alias("word")), index, classed, ending, stats.pos_prior(found), stats.form_prior(found))


@register("fuzzy_lemmatize", f"with {HYPOTHESES} select word, class_id, stem_len, lemma, weight, rank from ranked", tok=True)
def fuzzy_lemmatize(spark, sf_dir):
    return _hypotheses(spark, sf_dir).select("word", "class_id", "stem_len", "lemma", "weight", "rank")


@register("fuzzy_top1", f"with {HYPOTHESES} select word, class_id, lemma, weight from ranked where rank = 1", tok=True)
def fuzzy_top1(spark, sf_dir):
    return _hypotheses(spark, sf_dir).where("rank = 1").select("word", "class_id", "lemma", "weight")


@register(
    "exact_then_fuzzy",
    f"with {HYPOTHESES}, e as (select distinct folded as word, lexeme_id, lemma from tokens join forms on folded = form) select word, lemma, true as exact from e union all select word, lemma, false from ranked where rank = 1",
    tok=True,
)
def exact_then_fuzzy(spark, sf_dir):
    words = files.written(T.words(table(spark, sf_dir, "documents")))
    lemmas = forms_of(spark).select(F.col("form").alias("word"), "lexeme_id", "lemma").distinct()
    known = words.join(lexicon.for_join(lemmas), F.col("folded") == F.col("word"))
    return known.select("word", "lemma", F.lit(True).alias("exact")).unionByName(_hypotheses(spark, sf_dir, words).where("rank = 1").select("word", "lemma", F.lit(False).alias("exact")))


@register("fuzzy_build_form", f"with {CLASSES} select distinct stem, class_id, stem || ending as form from extracted join classes using (pos, endings) join fuzzy_endings using (class_id) where form_id = 1")
def fuzzy_build_form(spark, sf_dir):
    extracted, classed, _, ending, _ = _fuzzy(spark)
    stems = extracted.join(classed, ["pos", "endings"]).select("stem", "class_id")
    return fuzzy.build_form(stems, ending, 1).distinct()


@register(
    "fuzzy_intersection",
    f"""with {HYPOTHESES}, grams_of as (select word, class_id, stem_len, list_sort(list(distinct form_id)) as grams from hits group by all)
    select r.class_id, r.stem_len, r.word, o.word as other_word, array_to_string(list_sort(list_intersect(a.grams, b.grams)), ',') as grams
    from ranked r join ranked o on o.class_id = r.class_id and o.stem_len = r.stem_len and o.word = r.word || 's'
    join grams_of a on a.word = r.word and a.class_id = r.class_id and a.stem_len = r.stem_len join grams_of b on b.word = o.word and b.class_id = o.class_id and b.stem_len = o.stem_len""",
    tok=True,
)
def fuzzy_intersection(spark, sf_dir):
    found = _hypotheses(spark, sf_dir)
    pairs = found.select("word").distinct().withColumn("other_word", F.concat("word", F.lit("s")))
    both = fuzzy.intersection(pairs, found, found)
    return both.withColumn("grams", F.array_join(F.transform(F.sort_array("grams"), lambda x: x.cast("string")), ","))


@register("id_gaps", "with p as (select lexeme_id, lag(lexeme_id) over (order by lexeme_id) as after from (select distinct lexeme_id from articles)) select after, lexeme_id - after - 1 as gap from p where lexeme_id - after > 1")
def id_gaps(spark, sf_dir):
    return stats.id_gaps(lexicon.articles(lexicon.article_lines(spark)).select("lexeme_id"))


@register("duplicate_ids", "with ids as (select lexeme_id from articles union all select lexeme_id from articles where pos = 1) select lexeme_id, count(*) as n from ids group by 1 having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    ids = lexicon.articles(lexicon.article_lines(spark))
    return stats.duplicate_ids(ids.select("lexeme_id").union(ids.where("pos = 1").select("lexeme_id")))


@register(
    "dict_dump",
    """with d as (select lexeme_id, list_sort(list(distinct form)) as f from forms group by lexeme_id),
    p as (select *, f[1][1:coalesce(list_max(list_filter(range(1, least(len(f[1]), len(f[-1])) + 1), lambda i: f[1][1:i] = f[-1][1:i])), 0)] as stem from d)
    select lexeme_id, stem, array_to_string(list_transform(f, lambda x: x[len(stem) + 1:]), ',') as forms from p""",
)
def dict_dump(spark, sf_dir):
    return stats.dump(forms_of(spark))


@register("dict_diff", "with o as (select distinct lexeme_id, form from forms where pos <> 3), w as (select distinct lexeme_id, form from forms where pos <> 1) (select '<<' as side, * from (from o except all from w)) union all (select '>>' as side, * from (from w except all from o))")
def dict_diff(spark, sf_dir):
    forms = forms_of(spark).select("lexeme_id", "form", "pos").distinct()
    return stats.diff(forms.where("pos <> 3").select("lexeme_id", "form"), forms.where("pos <> 1").select("lexeme_id", "form"))


@register("rejects", "with bad(line) as (values ('// a comment'), ('word N'), ('word N LID:0'), ('word XX LID:5'), ('wordLID:5')) select line, case when starts_with(line, '//') then 'comment' when not regexp_matches(line, '[\\t ]LID:[0-9]+') then 'no number' when regexp_matches(line, 'LID:0+$') then 'number 0' else 'part of speech' end as reject from bad", lex=False)
def rejects(spark, sf_dir):
    return lexicon.rejects(spark.createDataFrame([(x,) for x in ("// a comment", "", "word N", "word N LID:0", "word XX LID:5", "wordLID:5")], "line string"))


CASE_SQL = "case when c < 3 then c when c = 3 then case when f & 2 <> 0 then 3 else 4 end else c + 1 end"


@register("gram_pack", f"with g as (select c, f, p, cast(c * 4096 + p * 2048 as integer) as gr from (select unnest(range(8)) as c), (select unnest(range(4)) as f), (select unnest(range(2)) as p)) select gr, cast(f as integer) as flags, cast({CASE_SQL} + 10 * p as integer) as form_id from g", lex=False)
def gram_pack(spark, sf_dir):
    base = spark.range(64).select((F.col("id") % 8 * 4096 + F.floor(F.col("id") / 32) * 2048).cast("int").alias("gr"), (F.floor(F.col("id") / 8) % 4).cast("int").alias("flags"))
    return base.select("gr", "flags", G.pack_noun(F.col("gr"), F.col("flags")).cast("int").alias("form_id"))


@register("gram_unpack", "with g as (select unnest(range(0, 20)) as f) select cast(f as integer) as form_id, cast(case when f > 17 or f % 10 > 8 then -1 else (case when f % 10 <= 3 then f % 10 else f % 10 - 1 end) * 4096 + case when f >= 10 then 2048 else 0 end end as integer) as gr from g", lex=False)
def gram_unpack(spark, sf_dir):
    base = spark.range(20).select(F.col("id").cast("int").alias("form_id"))
    return base.select("form_id", G.unpack_noun(F.col("form_id"), F.lit(False)).cast("int").alias("gr"))


@register("level_filter", "select cast(m as integer) as mask, cast(l as integer) as level from (select unnest(range(16)) as m), (select unnest(range(1, 5)) as l) where (m >> cast(l - 1 as integer)) & 1 = 1", lex=False)
def level_filter(spark, sf_dir):
    base = spark.range(64).select((F.col("id") % 16).cast("int").alias("mask"), (F.floor(F.col("id") / 16) + 1).cast("int").alias("level"))
    return base.where(G.in_level(F.col("mask"), F.col("level")))


@register(
    "swap_level",
    """with g as (select k, c, p, f from (select unnest(range(2, 8)) as k), (select unnest(range(8)) as c), (select unnest(range(2)) as p), (select unnest(range(4)) as f)),
    e as (select *, case when k in (4, 7) then case when f & 1 <> 0 then k - 1 else k - 2 end else k end as u from g)
    select cast(k as integer) as kind, cast(c * 4096 + p * 2048 as integer) as gr, cast(f as integer) as flags,
      case u when 2 then case when p = 0 and c in (0, 3) then 1 else 2 end when 3 then case when p = 0 and c = 0 then 1 else 2 end
        when 5 then case when p = 1 and c = 1 then 2 else 1 end else case when p = 1 and c in (1, 3) then 2 else 1 end end as level from e""",
    lex=False,
)
def swap_level(spark, sf_dir):
    base = spark.range(6 * 64).select((F.floor(F.col("id") / 64) + 2).cast("int").alias("kind"), (F.col("id") % 8 * 4096 + F.floor(F.col("id") / 8) % 2 * 2048).cast("int").alias("gr"), (F.floor(F.col("id") / 16) % 4).cast("int").alias("flags"))
    return base.select("*", G.swap_level(F.col("kind"), F.lit(0), F.col("gr"), F.col("flags")).alias("level"))


@register(
    "gram_pack_verb",
    """with g as (select t, r, p, n from (select unnest(range(1, 5)) as t), (select unnest(range(2)) as r), (select unnest(range(1, 4)) as p), (select unnest(range(2)) as n))
    select cast(t + 8 * p + 2048 * n + 32768 * r as integer) as gr,
      cast(case t when 1 then r when 2 then 2 + 2 * r + n when 3 then 6 + (p - 1) * 4 + 2 * r + n else 18 + (p - 1) * 4 + 2 * r + n end as integer) as form_id from g""",
    lex=False,
)
def gram_pack_verb(spark, sf_dir):
    i = F.col("id")
    gr = (i % 4 + 1) + 8 * (F.floor(i / 4) % 3 + 1) + 2048 * (F.floor(i / 12) % 2) + 32768 * F.floor(i / 24)
    return spark.range(48).select(gr.cast("int").alias("gr")).select("gr", G.pack(F.lit(1), F.col("gr"), F.lit(0)).cast("int").alias("form_id"))
