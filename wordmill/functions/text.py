"""Tokens and capitalization, as column expressions.

A word's capitalization scheme is (parts << 8) | codes, with two bits for each hyphen
part, the first part lowest: 0 small, 1 First, 2 ALL. Where a part is none of these the
scheme is 255. The apostrophe and the comma count as small letters; a single capital
counts as ALL; an empty part is an error unless it is the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Schemes that a word may have, by the least capitalization of its lexeme.
ALLOWED = {2: (0x0102, 0x020A, 0x032A), 1: (0x0101, 0x0205, 0x0311), 0: (0x0100, 0x0200, 0x0300, 0x0201, 0x0301)}
BAD_SCHEME = 255
#: Words of 48 characters or more are never looked up.
LONGEST = 47

# Token patterns. Words of letters; Russian letters; words with hyphens and apostrophes.
LETTERS, RUSSIAN, HYPHENATED = r"\p{L}+", "[а-яА-ЯёЁ]+", r"\p{L}[\p{L}'-]*"
# What single-byte tokenizers take for words. Anything beyond ASCII is a letter in all but CYRILLIC.
EXTENDED, CYRILLIC, UPPER_HALF = r"[A-Za-z\x{80}-\x{10FFFF}]+", "[А-Яа-яЁё][А-Яа-яЁё-]*", r"[A-\x{10FFFF}][A-\x{10FFFF}'-]*"


#: Tables of more files than this are never dealt out: a table that is large has many.
FEW_FILES = 16


def dealt(table: DataFrame) -> DataFrame:
    """A table of few files, fewer than cores, dealt out to all cores.

    A file's row groups are its only parts, and cutting texts costs far more than moving
    them once. A table of many files is left as it is.
    """
    if table.isStreaming:
        return table
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if 0 < len(table.inputFiles()) <= min(FEW_FILES, cores - 1) else table


def tokens(table: DataFrame, text: str = "text", pattern: str = LETTERS, least: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a token (a whole match of ``pattern``) of ``least`` characters or more, with the columns in ``keep``."""
    texts = dealt(table.select(*keep, text))
    return texts.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("token")).where(F.length("token") >= least)


def words(table: DataFrame, text: str = "text", pattern: str = LETTERS, least: int = 1) -> DataFrame:
    """folded, n, size: distinct words with counts and lengths.

    The last step reads every column, so that no reader prunes one: all branches of a
    plan over this table share its one scan and shuffle.
    """
    folded = tokens(table, text, pattern, least).select(F.lower("token").alias("folded")).where("folded is not null")
    return folded.groupBy("folded").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("folded")).alias("size")).where("n > 0 and size > 0")


def counted(table: DataFrame, *by: str) -> DataFrame:
    """Distinct tokens with counts: what a lexicon is joined with, instead of every occurrence."""
    return table.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n")).withColumn("folded", F.lower("token"))


def fold_yo(x: Column) -> Column:
    return F.translate(x, "ёЁ", "еЕ")


def cap_scheme(word: Column) -> Column:
    parts = F.split(word, "-", -1)

    def code(part: Column, i: Column) -> Column:
        last = (i == F.size(parts) - 1) & (i > 0)
        return F.when(part.rlike(r"^[\p{Ll}',]+$"), 0).when(part.rlike(r"^\p{Lu}[\p{Ll}',]+$"), 1).when(part.rlike(r"^\p{Lu}+$"), 2).when((part == "") & last, 0).otherwise(-1)

    codes = F.transform(parts, code)
    bits = F.aggregate(F.reverse(codes), F.lit(0), lambda acc, c: (acc * 4 + c).bitwiseAND(F.lit(255)))
    return F.when(F.exists(codes, lambda c: c < 0), BAD_SCHEME).otherwise(F.size(parts) * 256 + bits)


def cap_allowed(scheme: Column, min_cap: Column) -> Column:
    two = scheme.isin(*ALLOWED[2])
    one = two | scheme.isin(*ALLOWED[1])
    return F.when(min_cap == 2, two).when(min_cap == 1, one).otherwise(one | scheme.isin(*ALLOWED[0]))


def with_capitals(word: Column, min_cap: Column) -> Column:
    """A lower-case word in its least capitalization; the middle one of three parts stays small."""
    parts = F.split(word, "-", -1)
    first = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
    named = F.array_join(F.transform(parts, lambda p, i: F.when((F.size(parts) == 3) & (i == 1), p).otherwise(first(p))), "-")
    return F.when(min_cap == 2, F.upper(word)).when(min_cap == 1, named).otherwise(word)


def marked_stem(word: Column, stem_len: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), stem_len), F.lit("|"), F.substring(word, stem_len + 1, F.length(word)))


def without_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
