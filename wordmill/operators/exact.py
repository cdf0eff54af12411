"""Exact analysis: joins of tokens with word forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.functions import text as T
from wordmill.sources.lexicon import for_join


def hits(tokens: DataFrame, forms: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Tokens (token, folded, ...) with every word form they may be."""
    found = tokens.where(F.length("folded") <= T.LONGEST).join(for_join(forms), tokens["folded"] == forms["form"])
    return found if ignore_case else found.where(T.cap_allowed(T.cap_scheme(F.col("token")), F.col("min_cap")))


def check_word(tokens: DataFrame, forms: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Tokens that are known: a semi join."""
    on = (tokens["folded"] == forms["form"]) & (F.length(tokens["folded"]) <= T.LONGEST)
    if not ignore_case:
        on = on & T.cap_allowed(T.cap_scheme(tokens["token"]), forms["min_cap"])
    return tokens.join(for_join(forms), on, "left_semi")


def unknown_words(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    return tokens.join(for_join(forms), (tokens["folded"] == forms["form"]) & (F.length(tokens["folded"]) <= T.LONGEST), "left_anti")


def lemmatize(tokens: DataFrame, forms: DataFrame, ignore_case: bool = True, lemma: bool = True, grammar: bool = True) -> DataFrame:
    """token, lexeme_id, lemma, pos, form_id: a row for each reading; what isn't asked for is left out."""
    columns = ["token", "lexeme_id"] + ["lemma"] * lemma + ["pos", "form_id"] * grammar
    return hits(tokens, forms, ignore_case).select(columns).distinct()


def lemmatize_nested(tokens: DataFrame, forms: DataFrame, ignore_case: bool = True) -> DataFrame:
    """token, lexeme_id, lemma, pos, grams array<int>: a row for each lexeme, readings merged."""
    return hits(tokens, forms, ignore_case).groupBy("token", "lexeme_id").agg(F.min("lemma").alias("lemma"), F.min("pos").alias("pos"), F.sort_array(F.collect_set("form_id")).alias("grams"))


def first_only(tokens: DataFrame, forms: DataFrame, ignore_case: bool = True) -> DataFrame:
    """token, lexeme_id, form_id: one reading of each token, the one with the smallest lexeme and form."""
    found = hits(tokens, forms, ignore_case).groupBy("token").agg(F.min(F.struct("lexeme_id", "form_id")).alias("r"))
    return found.select("token", "r.lexeme_id", "r.form_id")


def as_json(tokens: DataFrame, forms: DataFrame, ignore_case: bool = True) -> DataFrame:
    """token, json: all lexemes of a token, as an array of objects with lemma, lexid, psp and forms."""
    nested = lemmatize_nested(tokens, forms, ignore_case)
    one = F.struct(F.col("lemma"), F.col("lexeme_id").alias("lexid"), F.col("pos").alias("psp"), F.col("grams").alias("forms"))
    rows = nested.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("lexeme_id", one.alias("x")))).alias("all"))
    return rows.select("token", F.to_json(F.transform("all", lambda r: r["x"])).alias("json"))


def without_range(table: DataFrame, low: int, high: int, column: str = "lexeme_id") -> DataFrame:
    """Rows whose number is outside a range, such as that of words that are not to be shown."""
    return table.where(~F.col(column).between(low, high))


def part_of_speech(ids: DataFrame, lexemes: DataFrame) -> DataFrame:
    """lexeme_id, pos; 0 if there is no such lexeme."""
    return ids.join(for_join(lexemes.select("lexeme_id", "pos")), "lexeme_id", "left").select("lexeme_id", F.coalesce("pos", F.lit(0)).alias("pos"))


def build_form(forms: DataFrame, lexeme_id: int | None = None, form_id: int | None = None) -> DataFrame:
    out = forms
    if lexeme_id is not None:
        out = out.where(F.col("lexeme_id") == lexeme_id)
    if form_id is not None:
        out = out.where(F.col("form_id") == form_id)
    return out.select("lexeme_id", "form_id", "surface")


def find_forms(tokens: DataFrame, forms: DataFrame, form_id: int, ignore_case: bool = True) -> DataFrame:
    """token, lexeme_id, surface: the given form of every lexeme of a token."""
    own = hits(tokens, forms, ignore_case).select("token", "lexeme_id").distinct()
    return own.join(for_join(forms.where(F.col("form_id") == form_id).select("lexeme_id", "surface")), "lexeme_id")
