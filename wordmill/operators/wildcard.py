"""Wildcard search: ``*`` is any run of characters, ``?`` one character."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_wildcard(pattern: str) -> bool:
    return bool(re.search(r"[*?]", pattern))


def is_asterisk(pattern: str) -> bool:
    return bool(re.fullmatch(r"\*+", pattern))


def like(pattern: str) -> str:
    """The pattern in the notation of LIKE; runs of ``*`` are one."""
    escaped = re.sub(r"([\\%_])", r"\\\1", pattern.lower())
    return re.sub(r"\*+", "%", escaped).replace("?", "_")


def matches(form: Column, pattern: str) -> Column:
    """LIKE, and the literal beginning as a predicate that reaches the scan."""
    found = form.like(like(pattern))
    start = re.match(r"[^*?]*", pattern.lower())[0]
    return form.startswith(start) & found if start else found


def find_match(forms: DataFrame, pattern: str) -> DataFrame:
    """lexeme_id, form, form_id of matching forms, each once."""
    return forms.where(matches(F.col("form"), pattern)).select("lexeme_id", "form", "form_id").distinct()


def grouped_matches(forms: DataFrame, pattern: str) -> DataFrame:
    """lexeme_id, matches array<struct<form, form_id>>: the matching forms of each lexeme together, each once."""
    return find_match(forms, pattern).groupBy("lexeme_id").agg(F.sort_array(F.collect_set(F.struct("form", "form_id"))).alias("matches"))


def each_match(forms: DataFrame, pattern: str, call, schema: str) -> DataFrame:
    """Rows that ``call(lexeme_id, matches)`` gives for each lexeme with matching forms, run where the lexemes are."""

    def called(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [row for x in batch.to_pylist() for row in call(x["lexeme_id"], [(m["form"], m["form_id"]) for m in x["matches"]])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return grouped_matches(forms, pattern).mapInArrow(called, schema)


def nouns_by_mask(forms: DataFrame, pattern: str, include: str = "", exclude: str = "", pos: tuple[int, int] = (7, 23), form_ids: tuple[int, ...] = (0, 255)) -> DataFrame:
    """Matching dictionary forms of parts of speech in a range, by their letters."""
    own = forms.where(F.col("pos").between(*pos) & F.col("form_id").isin(*form_ids))
    return letters_filter(own, pattern, include, exclude)


def first_matches(forms: DataFrame, pattern: str) -> DataFrame:
    """lexeme_id, form: the first matching form of each lexeme."""
    return find_match(forms, pattern).groupBy("lexeme_id").agg(F.min("form").alias("form"))


def enumerate_words(forms: DataFrame, pattern: str) -> DataFrame:
    """lexeme_id, form_id of matching forms, without text."""
    return find_match(forms, pattern).select("lexeme_id", "form_id").distinct()


def next_chars(forms: DataFrame, prefix: str) -> DataFrame:
    """next_char: what may follow a beginning, each once."""
    low = prefix.lower()
    return forms.where(F.col("form").startswith(low) & (F.length("form") > len(low))).select(F.substring("form", len(low) + 1, 1).alias("next_char")).distinct()


def letters_filter(forms: DataFrame, pattern: str, include: str = "", exclude: str = "") -> DataFrame:
    """Matching forms that hold all letters of ``include`` and none of ``exclude``."""
    out = find_match(forms, pattern)
    for c in include:
        out = out.where(F.col("form").contains(c))
    return out.where(~F.col("form").rlike(f"[{re.escape(exclude)}]")) if exclude else out
