"""Probable analysis of unknown words from paradigm classes of known ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions import grammar as G
from wordmill.functions import text as T
from wordmill.operators import training
from wordmill.operators.wildcard import like
from wordmill.sources.lexicon import for_join

# Weights of the parts of a hypothesis's score, the power that counts as full, and the factor of accented classes.
LENGTH_PART, POWER_PART, POS_PART, FORM_PART = 0.4, 0.3, 0.2, 0.1
FULL_POWER, ACCENT = 9000, 0.4
# The length prior by the ending's characters, from 0 on; longer ones have the last value.
LENGTH_PRIOR = (0.0, 0.05, 0.17, 0.55, 0.85, 0.97, 0.99, 0.99, 1.0)
COVER = 0.95


def common_prefix(low: Column, high: Column) -> Column:
    """The longest common prefix of a sorted group is that of its first and last member."""
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(low), F.length(high)), F.lit(1))), lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i))
    return F.substring(low, F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))


def extract(forms: DataFrame, least: int = 2, accents: bool = False) -> DataFrame:
    """lexeme_id, pos, stem, suffix, endings ('form_id:ending,...'), sample of every inflected lexeme whose forms share a stem.

    With ``accents`` there is a column ``accent``, whether the paradigm is stressed on its
    endings, and paradigms that differ in it make classes of their own.
    """
    out = _extract(forms, least)
    return out.join(training.accents(forms), "lexeme_id") if accents else out


def prepared(forms: DataFrame, mandatory: list[int] = (), optional: list[int] = (), as_well: dict[int, int] | None = None, numbers: dict[int, int] | None = None) -> DataFrame:
    """Forms as classes are trained on them: of lexemes with all mandatory ones, those of equal sound under both ids, ids renumbered."""
    out = training.selected(forms, list(mandatory), list(optional)) if mandatory else forms
    out = training.expanded(out, as_well) if as_well else out
    return training.renumbered(out, numbers) if numbers else out


def _key(table: DataFrame) -> list[str]:
    """What paradigm classes are told apart by."""
    return [c for c in ("pos", "endings", "accent") if c in table.columns]


def _extract(forms: DataFrame, least: int) -> DataFrame:
    group = forms.where("form_id <> 255").groupBy("lexeme_id", "pos").agg(
        F.min("form").alias("low"), F.max("form").alias("high"), F.min("lemma").alias("sample"), F.array_sort(F.collect_set(F.struct("form_id", "form"))).alias("all")
    )
    stem = group.withColumn("stem", common_prefix(F.col("low"), F.col("high"))).where(F.length("stem") >= least)
    endings = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["form_id"].cast("string"), F.substring(x["form"], F.length("stem") + 1, F.length(x["form"])))), ",")
    return stem.select("lexeme_id", "pos", "stem", F.right("stem", F.lit(2)).alias("suffix"), endings.alias("endings"), "sample")


def classes(extracted: DataFrame) -> DataFrame:
    """class_id, pos, endings (and accent), n: paradigm classes by how many lexemes they have."""
    key = _key(extracted)
    rank = F.dense_rank().over(Window.orderBy(*key))  # a row for each class, not each word
    return extracted.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(rank.alias("class_id"), *key, "n")


def classes_with(extracted: DataFrame, known: DataFrame) -> DataFrame:
    """``classes`` of a batch added to classes known before, which keep their numbers; new ones go on behind the last, in their order.

    known(class_id, pos, endings, n), or with accent, may be empty. Counts add up. Only
    what is new is numbered, so an old class never moves, whatever comes later.
    """
    key = _key(extracted)
    batch = extracted.groupBy(*key).agg(F.count(F.lit(1)).alias("more"))
    both = known.select("class_id", *key, "n").join(batch, key, "full_outer").withColumn("n", F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("more")
    last = known.agg(F.coalesce(F.max("class_id"), F.lit(0)).alias("last"))
    # a row for each class that is new
    fresh = both.where("class_id is null").withColumn("place", F.row_number().over(Window.orderBy(*key))).join(F.broadcast(last), F.lit(True))
    numbered = fresh.select((F.col("last") + F.col("place")).cast("int").alias("class_id"), *key, "n")
    return both.where("class_id is not null").select("class_id", *key, "n").unionByName(numbered)


def models(extracted: DataFrame, classed: DataFrame, wishes: DataFrame | None = None) -> DataFrame:
    """class_id, suffix, sample, weight: which stem ends a class has, with a sample word.

    ``wishes`` (lexeme_id, wish) marks lexemes whose words are wanted as samples ('+') or
    are to be avoided ('-'), where there is any other.
    """
    key = _key(extracted)
    own = extracted.join(classed.select("class_id", *key), key)
    if wishes is None:
        sample = F.min("sample")
    else:
        one = wishes.groupBy("lexeme_id").agg(F.max(F.when(F.col("wish") == "-", 2).otherwise(0)).alias("rank"))
        own = own.join(one, "lexeme_id", "left")
        sample = F.min(F.struct(F.coalesce("rank", F.lit(1)).alias("rank"), F.col("sample").alias("sample")))["sample"]
    return own.groupBy("class_id", "suffix").agg(sample.alias("sample"), F.count(F.lit(1)).alias("weight"))


def endings(classed: DataFrame) -> DataFrame:
    """class_id, form_id, ending."""
    return classed.select("class_id", F.explode(F.split("endings", ",")).alias("e")).select("class_id", F.split("e", ":")[0].cast("int").alias("form_id"), F.split("e", ":")[1].alias("ending"))


def covered(classed: DataFrame, share: float = COVER) -> DataFrame:
    """The largest classes while their sum stays within a share of all lexemes."""
    order = Window.orderBy(F.desc("n"), "class_id").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return classed.withColumn("running", F.sum("n").over(order)).withColumn("total", F.sum("n").over(every)).where(F.col("running") <= share * F.col("total")).drop("total")


def suffix_index(model: DataFrame, ending: DataFrame) -> DataFrame:
    """key, class_id, power, form_id, ending_len: a stem's last two characters and an ending."""
    return model.join(ending, "class_id").select(F.concat("suffix", "ending").alias("key"), "class_id", F.col("weight").alias("power"), "form_id", F.length("ending").alias("ending_len"))


def contained(classed: DataFrame) -> DataFrame:
    """class_id, into, size: pairs of classes of one part of speech where ``into`` has all endings of the first and more.

    A set-containment join: a class is joined with those that have its rarest ending, of
    all it has, and only these are compared as sets.
    """
    own = classed.select("class_id", "pos", F.array_distinct(F.split("endings", ",")).alias("set"))
    posted = own.select("class_id", "pos", F.explode("set").alias("e"))
    counts = posted.groupBy("pos", "e").agg(F.count(F.lit(1)).alias("n"))
    rarest = posted.join(counts, ["pos", "e"]).groupBy("class_id", "pos").agg(F.min_by("e", F.struct("n", "e")).alias("e"))
    other = posted.select(F.col("class_id").alias("into"), "pos", "e")
    candidates = rarest.join(other, ["pos", "e"]).where("class_id <> into").select("class_id", "into")
    less, more = own.select("class_id", F.col("set").alias("less")), own.select(F.col("class_id").alias("into"), F.col("set").alias("more"))
    both = candidates.join(less, "class_id").join(more, "into").where(F.size(F.array_except("less", "more")) == 0)
    return both.select("class_id", "into", F.size("less").alias("size"))


def merge_classes(classed: DataFrame, pos: int = 1, most_rounds: int = 64) -> DataFrame:
    """absorbed, into: classes of a part of speech whose endings another has all of, until none is left.

    In a round the classes, in their order, each take the covered class with the most
    endings (of equal ones the first) of those that are left; a class that was taken takes
    none. Covering is found by a containment join; only its pairs of classes, as few as
    paradigms are, are walked through on the driver.
    """
    pairs = contained(classed.where(F.col("pos") == pos)).orderBy("into", F.desc("size"), "class_id").collect()
    merged: list[tuple[int, int]] = []
    gone: set[int] = set()
    for _ in range(most_rounds):
        taken: dict[int, int] = {}
        for r in pairs:
            if r["class_id"] not in gone and r["into"] not in gone and r["into"] not in taken.values():
                taken[r["class_id"]] = r["into"]
                gone.add(r["class_id"])
        if not taken:
            break
        merged += taken.items()
    else:
        raise RuntimeError(f"classes did not settle in {most_rounds} rounds")
    into = dict(merged)
    last = lambda c: last(into[c]) if c in into else c
    return classed.sparkSession.createDataFrame([(b, last(a)) for b, a in merged], "absorbed int, into int")


def added_models(old: DataFrame, new: DataFrame) -> DataFrame:
    """class_id, suffix, sample, weight of two batches whose classes have the same numbers: weights add up, the first sample stays for all."""
    return old.unionByName(new).groupBy("class_id", "suffix").agg(F.min("sample").alias("sample"), F.sum("weight").alias("weight"))


def merged_models(model: DataFrame, merged: DataFrame) -> DataFrame:
    """class_id, suffix, sample, weight of ``models`` after classes were absorbed: their suffixes add up."""
    told = model.join(F.broadcast(merged), F.col("class_id") == F.col("absorbed"), "left")  # no more rows than there are classes
    return told.groupBy(F.coalesce("into", "class_id").alias("class_id"), "suffix").agg(F.min("sample").alias("sample"), F.sum("weight").alias("weight"))


def ranked_models(model: DataFrame) -> DataFrame:
    """Adds ``place``: the models of a class, the heaviest first, then by sample."""
    return model.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("weight"), "sample")))


def trigraphs(forms: DataFrame) -> DataFrame:
    """tri: every run of three letters that the lexicon has."""
    at = F.sequence(F.lit(1), F.length("form") - 2)
    return forms.where(F.length("form") >= 3).select(F.explode(F.transform(at, lambda i: F.substring(F.col("form"), i, F.lit(3)))).alias("tri")).distinct()


def wild_probe(index: DataFrame, pattern: str, plausible: DataFrame | None = None) -> DataFrame:
    """key, class_id, form_id, power of the suffix keys that a word matching ``pattern`` may end with.

    A key longer than what stands behind the pattern's last ``*`` must end with it, a
    shorter one must end it; ``?`` stands for any character. With ``plausible`` (tri) the
    three letters before and over a key's beginning must be plausible where the pattern
    gives the letter before it.
    """
    low = pattern.lower()
    tail = low[low.rfind("*") + 1 :]
    key = F.col("key")
    ends = [F.length(key) == n for n in range(1, len(tail))]
    short = [e & key.like(like(tail[len(tail) - n :])) for n, e in zip(range(1, len(tail)), ends)]
    fits = key.like("%" + like(tail)) if "*" in low else key.like(like(tail))
    for s in short:
        fits = fits | s
    found = index.where(fits).select("key", "class_id", "form_id", "power").distinct()
    if plausible is None:
        return found
    # the letter that the pattern has before a key of each length, where it has one
    before = F.lit(None).cast("string")
    for n in range(1, len(tail)):
        if tail[len(tail) - n - 1] != "?":
            before = F.when(F.length(key) == n, tail[len(tail) - n - 1]).otherwise(before)
    joint = found.withColumn("joint", F.concat(before, F.substring("key", 1, 2)))
    return joint.join(plausible, joint["joint"] == plausible["tri"], "left").where("joint is null or tri is not null").drop("joint", "tri")


def score(ending_len: Column, power: Column, pos_prior: Column, form_prior: Column, accent: Column | None = None) -> Column:
    length = F.lit(LENGTH_PRIOR[-1])
    for n in reversed(range(len(LENGTH_PRIOR) - 1)):
        length = F.when(ending_len <= n, LENGTH_PRIOR[n]).otherwise(length)
    total = LENGTH_PART * length + POWER_PART * F.log(power.cast("double")) / math.log(FULL_POWER) + POS_PART * F.coalesce(pos_prior, F.lit(0.0)) + FORM_PART * F.coalesce(form_prior, F.lit(0.0))
    return total if accent is None else total * F.when(accent, ACCENT).otherwise(1.0)


def candidates(words: DataFrame, index: DataFrame, ending: DataFrame) -> DataFrame:
    """word, class_id, stem_len, ending_len, form_id, power, grams, lemma: what words (folded, each once) may be by their ends.

    Suffixes are cut no longer than the longest key. Readings of one class and stem make
    one hypothesis, with the lowest form's number and power.
    """
    longest = index.agg(F.max(F.length("key"))).first()[0] or 0
    cut = words.where(F.length("word") >= 2).select("word", F.explode(F.sequence(F.lit(2), F.least(F.length("word"), F.lit(max(2, longest))))).alias("size")).select("word", F.right("word", F.col("size")).alias("key"))
    found = cut.join(for_join(index), "key").withColumn("stem_len", F.length("word") - F.col("ending_len"))
    # the least form and its power as one number, which is aggregated without sorting; a stem's length fixes the ending's
    first = F.min(F.shiftleft(F.col("form_id").cast("long"), 40) + F.col("power")).alias("f")
    group = found.groupBy("word", "class_id", "stem_len", "ending_len").agg(first, F.collect_set("form_id").alias("ids"))
    base = ending.groupBy("class_id").agg(F.min_by("ending", F.struct("form_id", "ending")).alias("base"))
    return group.join(for_join(base), "class_id").select(
        "word", "class_id", "stem_len", "ending_len", F.shiftright("f", 40).cast("int").alias("form_id"), (F.col("f") % (1 << 40)).alias("power"), F.sort_array("ids").alias("grams"), F.concat(F.substring("word", F.lit(1), F.col("stem_len")), "base").alias("lemma")
    )


def lemmatize(words: DataFrame, index: DataFrame, classed: DataFrame, ending: DataFrame, pos_prior: DataFrame, form_prior: DataFrame, capitals: bool = False) -> DataFrame:
    """word, class_id, stem_len, pos, grams, lemma, weight, rank: hypotheses for words (folded, each once), best first.

    Classes with ``accent`` weigh less where it is true. With ``capitals`` words have a
    column ``scheme`` (their capitalization, each word and scheme once): hypotheses whose
    part of speech would be written otherwise go, and lemmas are written as theirs is.
    """
    own = [c for c in ("class_id", "pos", "accent") if c in classed.columns]
    plain = words.select("word").distinct() if capitals else words
    told = candidates(plain, index, ending).join(for_join(classed.select(own)), "class_id")
    # a row for each part of speech (64 at most) and each of its forms (256 at most), whatever the corpus
    told = told.join(F.broadcast(pos_prior.select("pos", F.col("share").alias("pos_share"))), "pos", "left").join(F.broadcast(form_prior.select("pos", "form_id", F.col("share").alias("form_share"))), ["pos", "form_id"], "left")
    accent = F.col("accent") if "accent" in own else None
    weight = F.round(score(F.col("ending_len"), F.col("power"), F.col("pos_share"), F.col("form_share"), accent), 6)
    by = ["word"]
    if capitals:
        least = G.min_capitals(F.col("pos"))
        told = told.join(words.select("word", "scheme"), "word").where(T.cap_allowed(F.col("scheme"), least)).withColumn("lemma", T.with_capitals(F.col("lemma"), least))
        by = ["word", "scheme"]
    weighed = told.select(*by, "class_id", "stem_len", "pos", "grams", "lemma", weight.alias("weight"))
    return weighed.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "class_id", "stem_len")))


def build_form(stems: DataFrame, ending: DataFrame, form_id: int) -> DataFrame:
    """stem, class_id, form: a form of each stem by its class."""
    return stems.join(for_join(ending.where(F.col("form_id") == form_id)), "class_id").select("stem", "class_id", F.concat("stem", "ending").alias("form"))


def intersection(pairs: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """class_id, stem_len, word, other_word, grams: hypotheses that pairs(word, other_word) share, with the form ids of both."""
    left = one.select("class_id", "stem_len", "word", F.col("grams").alias("a")).join(pairs, "word")
    right = other.select("class_id", "stem_len", F.col("word").alias("other_word"), F.col("grams").alias("b"))
    return left.join(right, ["class_id", "stem_len", "other_word"]).select("class_id", "stem_len", "word", "other_word", F.array_intersect("a", "b").alias("grams"))
