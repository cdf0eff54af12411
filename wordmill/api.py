"""Analysers as objects: one over a table of word forms, one over paradigm classes.

Every method takes and gives DataFrames, or plain values for a single word, and runs as
a join; nothing is looked up word by word.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.operators import exact, fuzzy, stats, wildcard
from wordmill.sources import lexicon


class _Analyser:
    def __init__(self, spark: SparkSession, forms: DataFrame | None = None):
        self.spark = spark
        self.forms = lexicon.forms(spark) if forms is None else forms

    def words(self, words: str | Iterable[str] | DataFrame) -> DataFrame:
        """token, folded: a table of words from one, several, or a table with ``token``."""
        if isinstance(words, str):
            words = [words]
        table = words if isinstance(words, DataFrame) else self.spark.createDataFrame([(w,) for w in words], "token string")
        return table.select("token").distinct().withColumn("folded", F.lower("token"))


class Exact(_Analyser):
    """Words that a dictionary has."""

    def check_word(self, words, ignore_case: bool = False) -> DataFrame:
        """token of the words that are known."""
        return exact.check_word(self.words(words), self.forms, ignore_case).select("token")

    def lemmatize(self, words, ignore_case: bool = False) -> DataFrame:
        """token, lexeme_id, lemma, pos, grams of every lexeme that a word may be."""
        return exact.lemmatize_nested(self.words(words), self.forms, ignore_case)

    def build_form(self, lexeme: int | str, form_id: int) -> DataFrame:
        """lexeme_id, form_id, surface: a form of a lexeme, or of all lexemes of a word."""
        if isinstance(lexeme, int):
            return exact.build_form(self.forms, lexeme, form_id)
        own = exact.hits(self.words(lexeme), self.forms).select("lexeme_id").distinct()
        return exact.build_form(self.forms, form_id=form_id).join(own, "lexeme_id", "left_semi")

    def find_forms(self, words, form_id: int, ignore_case: bool = False) -> DataFrame:
        return exact.find_forms(self.words(words), self.forms, form_id, ignore_case)

    def find_match(self, pattern: str, call=None, schema: str | None = None) -> DataFrame:
        """lexeme_id, matches; or the rows that ``call(lexeme_id, matches)`` gives, by ``schema``."""
        return wildcard.grouped_matches(self.forms, pattern) if call is None else wildcard.each_match(self.forms, pattern, call, schema)

    def part_of_sp(self, lexeme_id: int) -> int:
        """The part of speech of a lexeme; 0 if there is none."""
        ids = self.spark.createDataFrame([(lexeme_id,)], "lexeme_id long")
        return exact.part_of_speech(ids, lexicon.lexemes(self.forms)).first()["pos"]


class Fuzzy(_Analyser):
    """Words that follow the paradigms of a dictionary's words. Priors come from ``words`` (folded, n), if given."""

    def __init__(self, spark: SparkSession, forms: DataFrame | None = None, words: DataFrame | None = None):
        super().__init__(spark, forms)
        extracted = fuzzy.extract(self.forms)
        self.classes = fuzzy.classes(extracted)
        self.models = fuzzy.models(extracted, self.classes)
        self.endings = fuzzy.endings(self.classes)
        self.index = fuzzy.suffix_index(self.models, self.endings)
        counted = self.forms.select(F.col("form").alias("folded")).distinct().withColumn("n", F.lit(1).cast("long")) if words is None else words
        found = stats.fractions(counted, self.forms)
        self.pos_prior, self.form_prior = stats.pos_prior(found), stats.form_prior(found)

    def lemmatize(self, words) -> DataFrame:
        """word, class_id, stem_len, pos, grams, lemma, weight, rank: hypotheses, best first."""
        own = self.words(words).select(F.col("folded").alias("word")).distinct()
        return fuzzy.lemmatize(own, self.index, self.classes, self.endings, self.pos_prior, self.form_prior)

    def build_form(self, stem: str, class_id: int, form_id: int) -> DataFrame:
        return fuzzy.build_form(self.spark.createDataFrame([(stem, class_id)], "stem string, class_id int"), self.endings, form_id)

    def get_sample(self, class_id: int) -> list[str]:
        """Sample words of a class, those of its heaviest models first."""
        own = fuzzy.ranked_models(self.models.where(F.col("class_id") == class_id))
        return [r["sample"] for r in own.orderBy("place").select("sample").collect()]

    def part_of_sp(self, class_id: int) -> int:
        found = self.classes.where(F.col("class_id") == class_id).select("pos").first()
        return found["pos"] if found else 0
