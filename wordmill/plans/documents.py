"""Queries over a lexicon that is derived from the documents and grows with them.

Most are queries of the other modules, planned over that lexicon; their SQL is the same
but for the common table ``forms``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill import sql
from wordmill.functions import text as T
from wordmill.operators import aligned, exact, fuzzy, letters, patterns, stats
from wordmill.plans import catalog, compilers  # noqa: F401 - the second registers its queries in the first
from wordmill.plans.catalog import ORACLES, QUERIES, table
from wordmill.sources import derived, files, lexicon, resolver, stored

_ENDINGS = ", ".join(f"({i}, '{e}')" for i, e in enumerate(derived.ENDINGS) if e)
#: What ``derived`` makes of the documents, under the names of the catalog's common tables.
DOCUMENTS_LEX = f"""
doc_vocabulary as (
  select lower(token) as folded, count(*) as n, min(case when token = lower(token) then 0 when token = upper(token) then 2 else 1 end) as min_cap
  from (select unnest(regexp_extract_all(text, '\\p{{L}}+')) as token from documents) group by 1 having length(folded) <= {T.LONGEST}),
doc_stems as (select folded as stem, min_cap from doc_vocabulary where length(folded) >= {derived.STEM}),
doc_endings(form_id, ending) as (values {_ENDINGS}),
doc_cut as (select left(w.stem, length(w.stem) - length(ending)) as stem, form_id, ending, w.stem as form from doc_stems w join doc_endings on ends_with(w.stem, ending) and length(w.stem) - length(ending) >= {derived.STEM}),
doc_paradigms as (select stem, form_id, ending, form, min_cap from doc_cut join doc_stems using (stem) union all select stem, 0, '', stem, min_cap from doc_stems),
forms as materialized (
  select cast('0x' || left(md5(stem), 15) as bigint) as lexeme_id, cast(lexeme_id % 3 + 1 as integer) as pos, form_id, ending, form, min_cap,
    {catalog._capitals_sql("stem")} as lemma, {catalog._capitals_sql("form")} as surface from doc_paradigms)"""


def documents_lexicon(spark: SparkSession, sf_dir: str) -> stored.Stored:
    """Saved once for an application."""

    def make() -> DataFrame:
        # stems, cut words and base forms are all made of the vocabulary: the documents are read once
        return derived.forms(vocabulary(spark, sf_dir))

    return stored.once(spark, sf_dir, make)


_words: dict[tuple[str, str], DataFrame] = {}


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folded, n, min_cap of the documents' words, written once for an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _words:
        _words[key] = files.written(derived.vocabulary(T.tokens(table(spark, sf_dir, "documents"), least=1)))
    return _words[key]


def over_documents(name: str) -> None:
    """Registers a query of the catalog again, as docs_..., over the documents' lexicon."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with catalog.planned_over(documents_lexicon(spark, sf_dir).forms):
            return QUERIES[name](spark, sf_dir)

    run.__doc__ = f"{name} over the lexicon derived from the documents."
    QUERIES[f"docs_{name}"] = run
    ORACLES[f"docs_{name}"] = ORACLES[name].replace(catalog.LEX, DOCUMENTS_LEX.lstrip())


OVER_DOCUMENTS = (
    "lex_expand lex_lexemes lex_coverage_conversations lex_coverage_benchmark lex_coverage_pages build_form find_match_prefix find_match_infix find_match_single find_match_double "
    "find_first_match enumerate_words next_chars letters_filter find_match_grouped find_match_callback nouns_by_mask normal_form_min "
    "class_extract class_productivity class_cut95 fuzzy_models models_ranked suffix_index suffix_reversed fuzzy_build_form class_json trigraphs fuzzy_wildcard "
    "dict_dump dict_diff marked_stems letter_marks letter_narrowed letter_picked lemmatize_nested find_forms lemma_frequency pos_prior form_prior fuzzy_lemmatize"
)
for _name in OVER_DOCUMENTS.split():
    over_documents(_name)


def register(name: str, sql: str):
    """Registers a query whose SQL reads the documents' ``forms``."""

    def add(f):
        QUERIES[name] = f
        head, body = (sql[5:].strip(), "") if sql.lower().startswith("with ") else ("", sql)
        ORACLES[name] = f"with {DOCUMENTS_LEX}" + (",\n" + head if head else "\n" + body)
        return f

    return add


def _tokens(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """token, n of the documents and of other tables. The documents' words were counted for the lexicon: their texts are not cut again."""
    out = vocabulary(spark, sf_dir).select(F.col("folded").alias("token"), "n")
    for name in names:
        out = out.unionAll(T.tokens(table(spark, sf_dir, name), least=1).select("token", F.lit(1).cast("long").alias("n")))
    return out


LOOKED_UP = "t as (select lower(token) as folded, count(*) as n from (select unnest(regexp_extract_all(text, '\\p{L}+')) as token from (select text from documents union all select text from conversations union all select text from benchmark)) group by 1)"


@register("stored_check_word", f"with {LOOKED_UP} select folded, n from t where folded in (select form from forms)")
def stored_check_word(spark, sf_dir):
    """Known tokens of three tables, through the filter and the buckets of the saved lexicon."""
    return documents_lexicon(spark, sf_dir).check_word(_tokens(spark, sf_dir, "conversations", "benchmark"), "n")


@register("stored_lemmatize", f"with {LOOKED_UP} select distinct folded, n, lexeme_id, lemma, pos, form_id from t join forms on folded = form")
def stored_lemmatize(spark, sf_dir):
    return documents_lexicon(spark, sf_dir).lemmatize(_tokens(spark, sf_dir, "conversations", "benchmark"), "n")


@register("docs_part_of_speech", "with ids as (select lexeme_id from forms where form_id = 0 union select o_orderkey from orders) select lexeme_id, coalesce(p.pos, 0) as pos from ids left join (select distinct lexeme_id, pos from forms) p using (lexeme_id)")
def docs_part_of_speech(spark, sf_dir):
    """Of all lexemes, and of the orders' numbers, which are none."""
    forms = documents_lexicon(spark, sf_dir).forms
    ids = forms.where("form_id = 0").select("lexeme_id").union(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long"))).distinct()
    return exact.part_of_speech(ids, lexicon.lexemes(forms))


@register("docs_without_range", "select lexeme_id, min(lemma) as lemma from forms where lexeme_id < 500000000000000000 or lexeme_id > 700000000000000000 group by lexeme_id")
def docs_without_range(spark, sf_dir):
    own = lexicon.lexemes(documents_lexicon(spark, sf_dir).forms).select("lexeme_id", "lemma")
    return exact.without_range(own, 500_000_000_000_000_000, 700_000_000_000_000_000)


@register(
    "docs_lexeme_order",
    """with t as (select distinct lower(unnest(regexp_extract_all(text, '\\p{L}+'))) as token from conversations), h as (select token, lexeme_id, cast(max(length(form) - length(ending)) as integer) as stem_len from t join forms on token = form group by all),
    r as (select lexeme_id, min(left(ending, 1)) as low, max(left(ending, 1)) as high from forms group by lexeme_id)
    select token, lexeme_id, stem_len, cast(row_number() over (partition by token order by stem_len desc, high desc, low, lexeme_id) as integer) as place from h join r using (lexeme_id)""",
)
def docs_lexeme_order(spark, sf_dir):
    """The lexemes of the conversations' tokens in the order of results: longest stem, then the range of their endings' first letters."""
    forms = documents_lexicon(spark, sf_dir).forms
    tokens = T.tokens(table(spark, sf_dir, "conversations"), least=1).select(F.lower("token").alias("token")).distinct().withColumn("folded", F.col("token"))
    found = exact.hits(tokens, forms).groupBy("token", "lexeme_id").agg(F.max(F.length("form") - F.length("ending")).alias("stem_len"))
    return resolver.ordered(found.join(resolver.letter_range(forms), "lexeme_id")).select("token", "lexeme_id", "stem_len", "place")


#: Five kinds of patterns for every word of the benchmark's texts: beginnings, ends, both, a gap, and length alone.
ASKED = """words as (select distinct lower(unnest(regexp_extract_all(text, '\\p{L}+'))) as w from benchmark),
asked as (select w[:4] || '*' as pattern from words where length(w) > 4 union select '*' || w[-4:] from words where length(w) > 4 union select w[:2] || '*' || w[-2:] from words where length(w) > 4
  union select w[:2] || '?' || w[4:] from words where length(w) > 4 union select repeat('?', length(w)) from words where length(w) > 8),
told as (select pattern, replace(replace(pattern, '*', '%'), '?', '_') as l from asked)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern: the patterns of ``ASKED``."""
    w = F.col("w")
    words = T.tokens(table(spark, sf_dir, "benchmark"), least=1).select(F.lower("token").alias("w")).distinct()
    cut = lambda first, n: F.substring(w, first, n)
    kinds = [F.concat(cut(1, 4), F.lit("*")), F.concat(F.lit("*"), F.right(w, F.lit(4))), F.concat(cut(1, 2), F.lit("*"), F.right(w, F.lit(2))), F.concat(cut(1, 2), F.lit("?"), F.substring(w, F.lit(4), F.length(w)))]
    long = F.when(F.length(w) > 8, F.array(F.expr("repeat('?', length(w))"))).otherwise(F.array().cast("array<string>"))
    return words.where(F.length(w) > 4).select(F.explode(F.concat(F.array(*kinds), long)).alias("pattern")).distinct()


@register("find_match_table", f"with {ASKED} select distinct pattern, lexeme_id, form, form_id from told join forms on form like l")
def find_match_table(spark, sf_dir):
    """All matches of all patterns."""
    return patterns.find_matches(documents_lexicon(spark, sf_dir).forms, asked(spark, sf_dir))


@register("find_first_match_table", f"with {ASKED} select pattern, lexeme_id, min(form) as form from told join forms on form like l group by pattern, lexeme_id")
def find_first_match_table(spark, sf_dir):
    return patterns.first_matches(documents_lexicon(spark, sf_dir).forms, asked(spark, sf_dir))


@register("find_match_table_grouped", f"with {ASKED}, m as (select distinct pattern, lexeme_id, form, form_id from told join forms on form like l) select pattern, lexeme_id, string_agg(form || ':' || form_id, ',' order by form, form_id) as matches from m group by pattern, lexeme_id")
def find_match_table_grouped(spark, sf_dir):
    found = patterns.grouped_matches(documents_lexicon(spark, sf_dir).forms, asked(spark, sf_dir))
    return found.withColumn("matches", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["form"], m["form_id"].cast("string"))), ","))


@register(
    "fuzzy_wildcard_table",
    f"""with {ASKED}, {catalog.CLASSES}, tails as (select pattern, string_split(pattern, '*')[-1] as tail, contains(pattern, '*') as open from asked where pattern like '*____')
    select distinct pattern, key, class_id, form_id, power from tails join suffix_index on (open or length(key) <= length(tail)) and right(key, least(length(key), length(tail))) like replace(right(tail, least(length(key), length(tail))), '?', '_')""",
)
def fuzzy_wildcard_table(spark, sf_dir):
    """Suffix keys that words with the ends of the benchmark's words may have."""
    with catalog.planned_over(documents_lexicon(spark, sf_dir).forms):
        return patterns.key_probes(catalog._fuzzy(spark)[4], asked(spark, sf_dir).where(F.col("pattern").like("*____")))


#: Dictionary files in two code pages, made of the documents' words: article lines with a Cyrillic postfix, some without a number.
PAGES = ("windows-1251", "koi8")
FILES = """lines as (
  select folded, lexeme_id, cast(lexeme_id % 2 as integer) as page, 'по-' || translate(folded, 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхийклмнопярстувшжыз') as postfix, lexeme_id % 10 = 7 as bad
  from (select stem as folded, cast('0x' || left(md5(stem), 15) as bigint) as lexeme_id from doc_stems where regexp_matches(stem, '^[a-z]+$')))"""


def dictionary_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Writes the lines of ``FILES`` to a folder for each code page."""
    words = documents_lexicon(spark, sf_dir).forms.where("form_id = 0").where(F.col("form").rlike("^[a-z]+$")).select("lexeme_id", F.col("form").alias("w"))
    cyrillic = F.translate("w", "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшжыз")
    number = F.when(F.col("lexeme_id") % 10 == 7, "").otherwise(F.concat(F.lit("\tLID:"), F.col("lexeme_id").cast("string")))
    lines = words.withColumn("line", F.concat("w", F.lit("|0|s\tN"), number, F.lit("\tpost:по-"), cyrillic))
    out = []
    for i, page in enumerate(PAGES):
        out.append(files.scratch(spark))
        files.save(lines.where(F.col("lexeme_id") % 2 == i), out[-1], page)
    return out


@register("article_files", f"with {FILES} select page, lexeme_id, folded as raw, '0|s' as spec, postfix, 1 as pos from lines where not bad")
def article_files(spark, sf_dir):
    """Articles of dictionary files in two code pages, read by the data source."""
    read = [files.load(spark, path, page).withColumn("page", F.lit(i)) for i, (path, page) in enumerate(zip(dictionary_files(spark, sf_dir), PAGES))]
    return read[0].unionByName(read[1]).select("page", "lexeme_id", "raw", "spec", "postfix", "pos")


@register("article_rejects", f"with {FILES} select page, folded || '|0|s' || chr(9) || 'N' || chr(9) || 'post:' || postfix as line from lines where bad")
def article_rejects(spark, sf_dir):
    """What was no article, from the sinks that loading wrote in the files' code pages."""
    out = []
    for i, (path, page) in enumerate(zip(dictionary_files(spark, sf_dir), PAGES)):
        files.load(spark, path, page, rejects_to=f"{path}-rejects")
        out.append(files.article_lines(spark, f"{path}-rejects", page).select(F.lit(i).alias("page"), "line"))
    return out[0].unionByName(out[1])


# --- classes, numbers, SQL functions ----------------------------------------------------------------------------------
@register(
    "docs_class_contained",
    f"""with {catalog.CLASSES}, e as (select distinct class_id, pos, unnest(string_split(endings, ',')) as e from classes), sized as (select *, count(*) over (partition by class_id) as size from e)
    select b.class_id, a.class_id as "into", cast(any_value(b.size) as integer) as size from sized b join sized a on a.pos = b.pos and a.e = b.e and a.class_id <> b.class_id group by b.class_id, a.class_id having count(*) = any_value(b.size)""",
)
def docs_class_contained(spark, sf_dir):
    """Classes of the documents' lexicon that another one covers."""
    with catalog.planned_over(documents_lexicon(spark, sf_dir).forms):
        return fuzzy.contained(catalog._fuzzy(spark)[1])


@register(
    "docs_fuzzy_intersection",
    f"""with {catalog.CLASSES}, w as (select distinct lower(unnest(regexp_extract_all(text, '\\p{{L}}+'))) as word from benchmark), asked as (select word from w where length(word) between 2 and 47),
    found as (select word, class_id, cast(length(word) - ending_len as integer) as stem_len, list_sort(list(distinct form_id)) as grams from asked join suffix_index on ends_with(word, key) group by all),
    pairs as (select a.word, b.word as other_word from asked a join asked b on b.word in (a.word || 's', a.word || 'es', a.word || 'ed', a.word || 'ing', a.word || 'er', a.word || 'en', a.word || 'ly'))
    select class_id, stem_len, word, other_word, array_to_string(list_sort(list_intersect(x.grams, y.grams)), ',') as grams from pairs join found x using (word) join (select word as other_word, class_id, stem_len, grams from found) y using (other_word, class_id, stem_len)""",
)
def docs_fuzzy_intersection(spark, sf_dir):
    """Hypotheses that a word of the benchmark shares with the word that has an ending more."""
    asked_for = T.words(table(spark, sf_dir, "benchmark")).where(F.col("size").between(2, T.LONGEST)).select(F.col("folded").alias("word"))
    with catalog.planned_over(documents_lexicon(spark, sf_dir).forms):
        _, _, _, ending, index = catalog._fuzzy(spark)
        found = fuzzy.candidates(asked_for, index, ending)
    longer = F.explode(F.transform(F.array(*map(F.lit, ("s", "es", "ed", "ing", "er", "en", "ly"))), lambda e: F.concat("word", e)))
    pairs = asked_for.select("word", longer.alias("other_word")).join(asked_for.withColumnRenamed("word", "other_word"), "other_word")
    both = fuzzy.intersection(pairs, found, found)
    return both.withColumn("grams", F.array_join(F.transform(F.sort_array("grams"), lambda x: x.cast("string")), ","))


@register("docs_letter_best", """with w as (select distinct form from forms where regexp_matches(form, '^[a-z]{5}$')), c as (select form, unnest(regexp_extract_all(form, '.')) as l from w), r as (select l, count(*) as n from c group by l)
    select form, cast(sum(n) as bigint) as rank from c join r using (l) group by form order by rank desc, form limit 1""")
def docs_letter_best(spark, sf_dir):
    """The five-letter word whose letters, repeated ones too, have the greatest ranks together."""
    own = documents_lexicon(spark, sf_dir).forms.where(F.col("form").rlike("^[a-z]{5}$")).select("form").distinct()
    return letters.best(own, letters.letter_ranks(own), repeats=True)


def _order_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("lexeme_id"))


def register_plain(name: str, statement: str):
    """Registers a query whose SQL needs no lexicon."""

    def add(f):
        QUERIES[name], ORACLES[name] = f, statement
        return f

    return add


@register_plain("order_key_gaps", "with p as (select k, lag(k) over (order by k) as after from (select distinct l_orderkey::bigint as k from lineitem)) select after, k - after - 1 as gap from p where k - after > 1")
def order_key_gaps(spark, sf_dir):
    """Orders without lines: the gaps of the keys, from the runs of bitmaps."""
    return stats.page_gaps(_order_keys(spark, sf_dir))


_PAGE = "case when k > 0 then (k - 1) // 32768 + 1 else 0 end"


@register_plain("order_key_runs", f"with p as (select k, k - row_number() over (order by k) as g, {_PAGE} as page from (select distinct l_orderkey::bigint as k from lineitem)) select page, min(k) as first, max(k) as last from p group by page, g")
def order_key_runs(spark, sf_dir):
    """Runs of keys without a gap, cut at pages."""
    return stats.runs(stats.pages(_order_keys(spark, sf_dir)))


@register_plain("order_key_free", f"""with used as (select distinct l_orderkey::bigint as k from lineitem), pages as (select distinct {_PAGE} as page from used),
  every as (select unnest(range(-32767, (select max(page) from pages) * 32768 + 1)) as k), free as (select k, {_PAGE} as page from every where k not in (select k from used) and {_PAGE} in (select page from pages)),
  p as (select k, page, k - row_number() over (order by k) as g from free) select page, min(k) as first, max(k) as last from p group by page, g""")
def order_key_free(spark, sf_dir):
    """Runs of unused numbers in the pages of the keys, from the complements of their bitmaps."""
    return stats.runs(stats.complement(stats.pages(_order_keys(spark, sf_dir))))


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement over ``tokens``, the distinct tokens of the conversations, and the functions over the documents' lexicon."""
    sql.register(spark, documents_lexicon(spark, sf_dir).forms)
    tokens = T.tokens(table(spark, sf_dir, "conversations"), least=1).select("token").distinct()
    return spark.sql(text, tokens=tokens)


TALKED = "t as (select distinct unnest(regexp_extract_all(text, '\\p{L}+')) as token from conversations)"


@register("sql_check_word", f"with {TALKED} select token from t where lower(token) in (select form from forms)")
def sql_check_word(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT token FROM {tokens} WHERE check_word(token)")


@register("sql_lemmatize", f"with {TALKED} select token, lexeme_id, min(lemma) as lemma, min(pos) as pos, string_agg(distinct cast(form_id as varchar), ',' order by cast(form_id as varchar)) as grams from t join forms on form = lower(token) group by token, lexeme_id")
def sql_lemmatize(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT t.token, l.lexeme_id, l.lemma, l.pos, array_join(array_sort(transform(l.grams, g -> cast(g AS string))), ',') AS grams FROM {tokens} t, LATERAL lemmatize(t.token) l")


@register("sql_find_forms", f"with {TALKED}, own as (select distinct token, lexeme_id from t join forms on form = lower(token)) select distinct token, lexeme_id, surface from own join forms using (lexeme_id) where form_id = 3")
def sql_find_forms(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT t.token, f.lexeme_id, f.surface FROM {tokens} t, LATERAL find_forms(t.token, 3) f")


@register("sql_build_form", "with ids as (select distinct lexeme_id from forms) select lexeme_id, (select min(surface) from forms f where f.lexeme_id = ids.lexeme_id and f.form_id = 1) as plural, (select min(pos) from forms f where f.lexeme_id = ids.lexeme_id) as pos from ids")
def sql_build_form(spark, sf_dir):
    forms = documents_lexicon(spark, sf_dir).forms
    sql.register(spark, forms)
    return spark.sql("SELECT lexeme_id, build_form(lexeme_id, 1) AS plural, part_of_sp(lexeme_id) AS pos FROM {ids}", ids=forms.select("lexeme_id").distinct())


# --- batches ----------------------------------------------------------------------------------------------------------
def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """folded, n of the words of documents with even and with odd numbers."""
    docs = table(spark, sf_dir, "documents")
    return [T.words(docs.where(F.col("doc_id") % 2 == i)) for i in (0, 1)]


@register(
    "merged_fractions",
    """with readings as (select form, lexeme_id, pos, list(distinct form_id) as ids from forms group by form, lexeme_id, pos), nl as (select form, count(*) as lexemes from readings group by form),
    shares as (select form, pos, unnest(ids) as form_id, 1.0::double / lexemes / len(ids) as share from readings join nl using (form))
    select pos, form_id, round(sum(n * share), 4) as n from doc_vocabulary join shares on folded = form group by pos, form_id""",
)
def merged_fractions(spark, sf_dir):
    """Fractional frequencies of two halves of the documents, added up: those of the whole."""
    forms = documents_lexicon(spark, sf_dir).forms
    return stats.added(*[stats.fractions(half, forms) for half in _halves(spark, sf_dir)]).withColumn("n", F.round("n", 4))


@register(
    "merged_classes",
    f"""with {catalog.CLASSES}, one as (select pos, endings, count(*) filter (lexeme_id % 2 = 0) as old, count(*) filter (lexeme_id % 2 = 1) as more from extracted group by pos, endings),
    numbered as (select *, row_number() over (order by old = 0, pos, endings) as class_id from one) select cast(class_id as integer) as class_id, pos, endings, old + more as n from numbered""",
)
def merged_classes(spark, sf_dir):
    """Classes of the lexemes with even numbers, to which those with odd ones are added: old numbers stay."""
    with catalog.planned_over(documents_lexicon(spark, sf_dir).forms):
        extracted = catalog._fuzzy(spark)[0]
    return fuzzy.classes_with(extracted.where("lexeme_id % 2 = 1"), fuzzy.classes(extracted.where("lexeme_id % 2 = 0")))


@register(
    "merged_models",
    f"""with {catalog.CLASSES}, one as (select pos, endings, count(*) filter (lexeme_id % 2 = 0) as old from extracted group by pos, endings),
    numbered as (select *, row_number() over (order by old = 0, pos, endings) as class_id from one) select cast(class_id as integer) as class_id, suffix, min(sample) as sample, count(*) as weight from extracted join numbered using (pos, endings) group by class_id, suffix""",
)
def merged_models(spark, sf_dir):
    with catalog.planned_over(documents_lexicon(spark, sf_dir).forms):
        extracted = catalog._fuzzy(spark)[0]
    even, odd = extracted.where("lexeme_id % 2 = 0"), extracted.where("lexeme_id % 2 = 1")
    classed = fuzzy.classes_with(odd, fuzzy.classes(even))
    return fuzzy.added_models(fuzzy.models(even, classed), fuzzy.models(odd, classed))


# --- dumps ------------------------------------------------------------------------------------------------------------
def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(place, line) of all lines of the conversations, and of a later state of them: some turns gone, some lines edited."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and text is not null").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    place = F.struct("conv_id", "turn", "i")  # one number would mix conversations where turns are many
    old = turns.select("conv_id", "turn", place.alias("place"), "line")
    edited = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), F.concat(F.col("line"), F.lit(" (edited)"))).otherwise(F.col("line"))
    new = old.where((F.col("conv_id") + F.col("turn")) % 7 != 3).select("place", edited.alias("line"))
    return old.select("place", "line"), new


@register_plain(
    "dump_edits",
    """with l as (select conv_id, turn, i, string_split(text, chr(10))[i + 1] as line from (select conv_id, turn, text, unnest(range(len(string_split(text, chr(10))))) as i from conversations)),
    t as (select *, (conv_id + turn) % 7 = 3 as gone, conv_id % 5 = 0 and turn = 1 as edited from l)
    select '<<' as side, line, count(*) as n from t where gone or edited group by line union all select '>>', line || ' (edited)', count(*) from t where edited and not gone group by line""",
)
def dump_edits(spark, sf_dir):
    """Lines removed and added between two snapshots of the conversations, as their aligned comparison finds them."""
    return aligned.edits(*snapshots(spark, sf_dir)).groupBy("side", "line").agg(F.count(F.lit(1)).alias("n"))
