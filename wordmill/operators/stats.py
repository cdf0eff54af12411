"""Corpus and lexicon statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.operators.fuzzy import common_prefix
from wordmill.sources.lexicon import for_join


def coverage(tokens: DataFrame, forms: DataFrame, by: str) -> DataFrame:
    """by, total, known: tokens in all and tokens that the lexicon has. ``tokens`` has by, folded, n."""
    known = forms.select(F.col("form").alias("folded")).distinct().withColumn("hit", F.lit(1))
    return tokens.join(for_join(known), "folded", "left").groupBy(by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("known"))


def fractions(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """pos, form_id, n: each occurrence of a token is shared by its lexemes, and a lexeme's part by its readings."""
    readings = forms.groupBy("form", "lexeme_id", "pos").agg(F.collect_set("form_id").alias("ids"))
    lexemes = readings.groupBy("form").agg(F.count(F.lit(1)).alias("lexemes"))
    shares = readings.join(lexemes, "form").select("form", "pos", F.explode("ids").alias("form_id"), (1 / F.col("lexemes") / F.size("ids")).alias("share"))
    counts = tokens.groupBy("folded").agg(F.sum("n").alias("n"))
    return counts.join(for_join(shares), counts["folded"] == shares["form"]).groupBy("pos", "form_id").agg(F.sum(F.col("n") * F.col("share")).alias("n"))


def added(*batches: DataFrame) -> DataFrame:
    """pos, form_id, n of several batches' ``fractions``: sums, so batches merge in any order and any grouping."""
    out = batches[0]
    for other in batches[1:]:
        out = out.unionByName(other)
    return out.groupBy("pos", "form_id").agg(F.sum("n").alias("n"))


def added_words(*batches: DataFrame) -> DataFrame:
    """folded, n of several batches' words."""
    out = batches[0].select("folded", "n")
    for other in batches[1:]:
        out = out.unionByName(other.select("folded", "n"))
    return out.groupBy("folded").agg(F.sum("n").alias("n"))


def pos_prior(found: DataFrame) -> DataFrame:
    """pos, share of all."""
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return found.groupBy("pos").agg(F.sum("n").alias("n")).select("pos", F.round(F.col("n") / F.sum("n").over(every), 6).alias("share"))


def form_prior(found: DataFrame) -> DataFrame:
    """pos, form_id, share within the part of speech."""
    return found.select("pos", "form_id", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("pos")), 6).alias("share"))


def id_gaps(ids: DataFrame, page: int = 1 << 16) -> DataFrame:
    """after, gap: unused numbers between used ones.

    Numbers are looked at in pages of their own; only the first and last of each page
    meet those of the next, so no task holds more than a page or the list of pages.
    """
    used = ids.select("lexeme_id").distinct().withColumn("page", F.floor(F.col("lexeme_id") / page))
    before = F.lag("lexeme_id").over(Window.partitionBy("page").orderBy("lexeme_id"))
    inside = used.select(before.alias("after"), "lexeme_id")
    ends = used.groupBy("page").agg(F.min("lexeme_id").alias("low"), F.max("lexeme_id").alias("high"))
    across = ends.select(F.lag("high").over(Window.orderBy("page")).alias("after"), F.col("low").alias("lexeme_id"))
    return inside.union(across).select("after", (F.col("lexeme_id") - F.col("after") - 1).alias("gap")).where("gap > 0")


def id_pages(ids: DataFrame) -> DataFrame:
    """page, used, free: numbers used and free in each page of 32,768, by bitmaps."""
    one = ids.select("lexeme_id").distinct()
    bits = one.groupBy(F.bitmap_bucket_number("lexeme_id").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("lexeme_id")).alias("bits"))
    return bits.select("page", F.bitmap_count("bits").alias("used"), (F.lit(1 << 15) - F.bitmap_count("bits")).alias("free"))


#: Numbers in a page of a bitmap.
PAGE = 1 << 15


def pages(ids: DataFrame) -> DataFrame:
    """page, bits: which of a page's 32,768 numbers are used; page 1 begins with number 1, page 0 goes down from 0."""
    return ids.groupBy(F.bitmap_bucket_number("lexeme_id").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("lexeme_id")).alias("bits"))


def complement(of: DataFrame) -> DataFrame:
    """page, bits of pages(page, bits) with every bit turned over."""
    return of.select("page", F.unhex(F.translate(F.hex("bits"), "0123456789ABCDEF", "FEDCBA9876543210")).alias("bits"))


def runs(of: DataFrame) -> DataFrame:
    """page, first, last: the runs of set bits of pages(page, bits), as numbers.

    A page is written out as a string of noughts and ones, the lowest first, and cut into
    runs; their places are running sums of their lengths. No number is listed by itself.
    """
    lowest_first = F.translate(F.regexp_replace(F.hex("bits"), "(.)(.)", "$2$1"), "0123456789ABCDEF", "abcdefghijklmnop")
    for i in range(16):
        lowest_first = F.replace(lowest_first, F.lit("abcdefghijklmnop"[i]), F.lit(f"{i:04b}"[::-1]))
    cut = of.select("page", F.posexplode(F.regexp_extract_all(lowest_first, F.lit("0+|1+"), F.lit(0))).alias("i", "run"))
    before = Window.partitionBy("page").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("at", F.coalesce(F.sum(F.length("run")).over(before), F.lit(0))).where(F.col("run").startswith("1"))
    up, low, high = F.col("page") > 0, F.col("at"), F.col("at") + F.length("run") - 1
    base = (F.col("page") - 1) * PAGE + 1
    first = F.when(up, base + low).otherwise(F.col("page") * PAGE - high)
    last = F.when(up, base + high).otherwise(F.col("page") * PAGE - low)
    return placed.select("page", first.alias("first"), last.alias("last"))


def page_gaps(ids: DataFrame) -> DataFrame:
    """after, gap: what ``id_gaps`` gives, from the runs of bitmaps."""
    used = runs(pages(ids))
    inside = used.select(F.lag("last").over(Window.partitionBy("page").orderBy("first")).alias("after"), "first")
    ends = used.groupBy("page").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    across = ends.select(F.lag("last").over(Window.orderBy("page")).alias("after"), "first")  # a row for each page
    return inside.union(across).select("after", (F.col("first") - F.col("after") - 1).alias("gap")).where("gap > 0")


def duplicate_ids(ids: DataFrame) -> DataFrame:
    return ids.groupBy("lexeme_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dump(forms: DataFrame) -> DataFrame:
    """lexeme_id, stem, forms: what all forms of a lexeme begin with, and the rest of each, in order, joined."""
    own = forms.groupBy("lexeme_id").agg(F.array_sort(F.collect_set("form")).alias("all"))
    own = own.withColumn("stem", common_prefix(F.array_min("all"), F.array_max("all")))
    rest = F.transform("all", lambda x: F.substring(x, F.length("stem") + 1, F.length(x)))
    return own.select("lexeme_id", "stem", F.array_join(rest, ",").alias("forms"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """side ('<<' or '>>') and the rows that only one of two dumps has."""
    return old.exceptAll(new).select(F.lit("<<").alias("side"), "*").union(new.exceptAll(old).select(F.lit(">>").alias("side"), "*"))


def samples(words: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """word, n, class_id, power, ending_len, hit: words(folded, n) with their candidates, and whether one has a known lemma of the word."""
    lemmas = known.select(F.col("form").alias("word"), F.lower("lemma").alias("lemma"), F.lit(1).alias("hit")).distinct()
    counts = words.select(F.col("folded").alias("word"), "n")
    return candidates.join(counts, "word").join(for_join(lemmas), ["word", "lemma"], "left").select("word", "n", "class_id", "power", "ending_len", F.coalesce("hit", F.lit(0)).alias("hit"))


def frequency(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """lexeme_id, lemma, n: occurrences of each lexeme's forms."""
    own = forms.select("form", "lexeme_id", "lemma").distinct()
    return tokens.join(for_join(own), tokens["folded"] == own["form"]).groupBy("lexeme_id", "lemma").agg(F.sum("n").alias("n"))


def pos_by(tokens: DataFrame, forms: DataFrame, by: str) -> DataFrame:
    """by, pos, n: occurrences of tokens that may be of a part of speech."""
    own = forms.select("form", "pos").distinct()
    return tokens.join(for_join(own), tokens["folded"] == own["form"]).groupBy(by, "pos").agg(F.sum("n").alias("n"))

