"""A lexicon derived from the words of a corpus, as large as its vocabulary.

Every word is a lexeme with itself as its base form; a word that is another word (its
stem) and a listed ending is a form of that lexeme, too. So an unknown language gets
paradigms by what stands in its texts, and the tables of ``lexicon`` for any size.

A lexeme's number is made of its stem's digest, which needs no count over all words; its
least capitalization is the least that the corpus shows (0 small, 1 First, 2 ALL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.functions import text as T

#: Endings in the order of their form ids, the base form first.
ENDINGS = ("", "s", "es", "ing", "ed", "er", "en", "ly", "tion", "st", "ment", "eux", "te", "lich", "keit", "do")
#: Letters that a stem has at least.
STEM = 3


def lexeme_id(stem: Column) -> Column:
    """A number of 60 bits from a stem's digest."""
    return F.conv(F.substring(F.md5(stem), 1, 15), 16, 10).cast("long")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """folded, n, min_cap of tokens(token): distinct words of a length that is looked up."""
    # counted as they stand first: what folds a token and tells its capitals is asked once for each spelling
    spelled = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    low, up = F.lower("token"), F.upper("token")
    cap = F.when(F.col("token") == low, 0).when(F.col("token") == up, 2).otherwise(1)
    found = spelled.select(low.alias("folded"), "n", cap.alias("cap")).groupBy("folded")
    # the length is aggregated, so that no filter by it moves to the occurrences
    counted = found.agg(F.sum("n").alias("n"), F.min("cap").alias("min_cap"), F.max(F.length("folded")).alias("size"))
    return counted.where(F.col("size").between(1, T.LONGEST)).drop("size")


def forms(words: DataFrame, endings: tuple[str, ...] = ENDINGS, least: int = STEM) -> DataFrame:
    """The columns of ``lexicon.expand`` for a table of words (folded, min_cap), each once.

    Words are cut by every ending they have and joined once with the words themselves, by
    the stem; a stem has as many rows as there are endings, at most.
    """
    known = words.where(F.length("folded") >= least)
    word = F.col("folded")
    listed = F.array(*[F.struct(F.lit(i).alias("form_id"), F.lit(e).alias("ending")) for i, e in enumerate(endings) if i])
    has = F.filter(listed, lambda x: word.endswith(x["ending"]) & (F.length(word) - F.length(x["ending"]) >= least))
    cut = known.select("folded", F.explode(has).alias("x")).select(
        F.substring(word, F.lit(1), F.length(word) - F.length("x.ending")).alias("stem"), F.col("x.form_id").alias("form_id"), F.col("x.ending").alias("ending"), word.alias("form")
    )
    stems = known.select(word.alias("stem"), "min_cap")
    derived = cut.join(stems.hint("merge"), "stem")
    base = stems.select("stem", F.lit(0).alias("form_id"), F.lit("").alias("ending"), F.col("stem").alias("form"), "min_cap")
    both = derived.unionByName(base).withColumn("lexeme_id", lexeme_id(F.col("stem")))
    return both.select(
        "lexeme_id", (F.col("lexeme_id") % 3 + 1).cast("int").alias("pos"), "form_id", "ending", "form", "min_cap",
        T.with_capitals(F.col("stem"), F.col("min_cap")).alias("lemma"), T.with_capitals(F.col("form"), F.col("min_cap")).alias("surface"),
    )
