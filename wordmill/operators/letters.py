"""Games of letters over dictionary words: marking a guess, narrowing by marks, ranking candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def marked(target: Column, guess: Column) -> Column:
    """For each letter of a guess: itself in its place, ``+`` if it stands elsewhere in the target, else ``-``."""
    own = _chars(target)
    at = lambda c, i: F.when(F.get(own, i) == c, c).when(F.array_contains(own, c), "+").otherwise("-")
    return F.array_join(F.transform(_chars(guess), at), "")


def narrowed(words: DataFrame, guesses: list[tuple[str, str]], column: str = "form") -> DataFrame:
    """Words that agree with all guesses and their marks, as if each were the target."""
    out = words
    for guess, marks in guesses:
        out = out.where(marked(F.col(column), F.lit(guess)) == marks)
    return out


def letter_ranks(words: DataFrame, column: str = "form") -> DataFrame:
    """letter, n: in how many places of all words each letter stands."""
    return words.select(F.explode(_chars(F.col(column))).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))


def best(words: DataFrame, ranks: DataFrame, column: str = "form", repeats: bool = False) -> DataFrame:
    """The word with the greatest sum of its letters' ranks, of different ones or, with ``repeats``, of all; of equal words the first."""
    letters = _chars(F.col(column)) if repeats else F.array_distinct(_chars(F.col(column)))
    own = words.select(column).distinct().select(column, F.explode(letters).alias("letter"))
    # letters of an alphabet: a few dozen rows whatever the words
    told = own.join(F.broadcast(ranks), "letter").groupBy(column).agg(F.sum("n").alias("rank"))
    return told.orderBy(F.desc("rank"), column).limit(1)


def picked(ranks: DataFrame, draws: DataFrame) -> DataFrame:
    """draw, letter: for each draw(draw, u) with u from 0 to 1 the letter whose share of all ranks u falls into."""
    one = ranks.agg(F.array_sort(F.collect_list(F.struct("letter", "n"))).alias("all"))  # one row: the alphabet
    sums = F.transform(F.sequence(F.lit(1), F.size("all")), lambda i: F.aggregate(F.slice("all", F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]))
    table = one.withColumn("sums", sums)
    told = draws.join(F.broadcast(table), F.lit(True))
    first = F.expr("filter(sequence(0, size(sums) - 1), i -> floor(u * sums[size(sums) - 1]) <= sums[i])[0]")
    return told.select("draw", F.get("all", first)["letter"].alias("letter"))
