"""Wildcard search for a table of patterns: ``*`` is any run of characters, ``?`` one character.

Forms are posted under their n-grams, of one to ``LONGEST_GRAM`` letters, with marks at both
ends. A pattern's literal runs have n-grams as well, all of which a matching form must
have; the pattern is joined with the postings of the rarest one, and LIKE decides. A
pattern with an n-gram that no form has matches nothing. Patterns without a literal go to
the forms by length. All joins are equi-joins. Patterns are sent to all tasks where their
rows and bytes are checked to be few (``lexicon.is_small``); the postings never are, whose
size Spark can't tell, as they are cut from the forms. Where patterns are many, a frequent
n-gram's postings are dealt into ``SALTS`` parts, to each of which its patterns go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.functions.text import LONGEST
from wordmill.sources import files
from wordmill.sources.lexicon import for_join, is_small

LONGEST_GRAM, SALTS = 3, 16
#: Marks of a word's beginning and end.
BEGIN, END = "\u0002", "\u0003"


def like_pattern(pattern: Column) -> Column:
    """A pattern in the notation of LIKE with backslashes; runs of ``*`` are one."""
    escaped = F.regexp_replace(F.lower(pattern), r"([\\%_])", r"\\$1")
    return F.translate(F.regexp_replace(escaped, r"\*+", "%"), "?", "_")


def grams(text: Column, longest: int = LONGEST_GRAM) -> Column:
    """The distinct n-grams of a text with both marks, without those of marks alone."""
    marked = F.concat(F.lit(BEGIN), text, F.lit(END))
    return F.filter(_cut(marked, longest), lambda g: ~g.isin(BEGIN, END, BEGIN + END))


def pattern_grams(pattern: Column, longest: int = LONGEST_GRAM) -> Column:
    """The distinct n-grams that every match of a pattern has."""
    marked = F.concat(F.lit(BEGIN), F.lower(pattern), F.lit(END))
    runs = F.filter(F.split(marked, "[*?]+"), lambda r: r != "")
    return F.filter(F.array_distinct(F.flatten(F.transform(runs, lambda r: _cut(r, longest)))), lambda g: ~g.isin(BEGIN, END, BEGIN + END))


def _cut(text: Column, longest: int) -> Column:
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))), lambda g: F.length(g) == n)

    return F.array_distinct(F.concat(*[of(n) for n in range(1, longest + 1)]))


def postings(forms: DataFrame, salts: int = SALTS, longest: int = LONGEST_GRAM) -> DataFrame:
    """gram, part, form of every distinct form."""
    own = forms.select("form").where(F.length("form") <= LONGEST).distinct()
    return own.select(F.explode(grams(F.col("form"), longest)).alias("gram"), F.pmod(F.xxhash64("form"), F.lit(salts)).cast("int").alias("part"), "form")


def _fits(found: DataFrame) -> DataFrame:
    return found.where(F.expr("form like _like escape '\\\\'")).select("pattern", "form")


def matching(forms: DataFrame, patterns: DataFrame, salts: int = SALTS, longest: int = LONGEST_GRAM) -> DataFrame:
    """pattern, form: the distinct forms that each distinct pattern of patterns(pattern) matches, each pair once."""
    told = patterns.select("pattern").where("pattern is not null").distinct().select("pattern", like_pattern(F.col("pattern")).alias("_like"), pattern_grams(F.col("pattern"), longest).alias("_grams"))
    told = files.written(told)  # each step below is a plan of its own, which the driver holds while it runs
    asked = told.where(F.size("_grams") > 0).select("pattern", "_like", F.explode("_grams").alias("gram"))
    # only what a pattern has is counted; that is told to all tasks where the patterns are few
    posted = postings(forms, salts, longest)
    counts = posted.join(for_join(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    # the rarest n-gram of each pattern; one that no form has counts 0 and joins nothing
    rarest = asked.join(counts.hint("merge"), "gram", "left").groupBy("pattern", "_like").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("gram").alias("gram"))).alias("r"))
    rarest = files.written(rarest.where("r.n > 0").select("pattern", "_like", F.col("r.gram").alias("gram")))
    if is_small(rarest):
        by_gram = _fits(posted.join(F.broadcast(rarest), "gram"))
    else:
        dealt = rarest.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"))
        own = posted.join(for_join(rarest.select("gram").distinct()), "gram", "left_semi")
        by_gram = _fits(own.join(dealt.hint("merge"), ["gram", "part"]))
    # without a literal: by length, and, where such patterns are many, by first letter, so that one length is many keys
    sized = forms.select("form").where(F.length("form") <= LONGEST).distinct().select(F.length("form").alias("_size"), F.substring("form", 1, 1).alias("_first"), "form")
    least = F.length(F.replace("_like", F.lit("%"), F.lit("")))
    lengths = F.when(F.contains("_like", F.lit("%")), F.sequence(least, F.greatest(least, F.lit(LONGEST)))).otherwise(F.array(least))
    open_ = told.where(F.size("_grams") == 0).select("pattern", "_like", F.explode(lengths).alias("_size"))
    if is_small(open_):
        by_shape = _fits(sized.join(F.broadcast(open_), "_size"))
    else:
        shapes = sized.select("_size", "_first").distinct()
        by_shape = _fits(sized.join(open_.join(shapes.hint("merge"), "_size").hint("merge"), ["_size", "_first"]))
    return by_gram.unionByName(by_shape)


def find_matches(forms: DataFrame, patterns: DataFrame, salts: int = SALTS) -> DataFrame:
    """pattern, lexeme_id, form, form_id of matching forms, each once."""
    readings = forms.select("form", "lexeme_id", "form_id").distinct()
    return matching(forms, patterns, salts).join(readings.hint("merge"), "form").select("pattern", "lexeme_id", "form", "form_id")


def first_matches(forms: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, lexeme_id, form: the first matching form of each lexeme."""
    return find_matches(forms, patterns).groupBy("pattern", "lexeme_id").agg(F.min("form").alias("form"))


def grouped_matches(forms: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, lexeme_id, matches array<struct<form, form_id>>: the matching forms of each lexeme together."""
    return find_matches(forms, patterns).groupBy("pattern", "lexeme_id").agg(F.sort_array(F.collect_list(F.struct("form", "form_id"))).alias("matches"))


def key_probes(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, key, class_id, form_id, power of the suffix keys that a word matching each pattern may end with.

    What stands behind a pattern's last ``*`` and a key must agree from the end on, as far
    as the shorter one goes; a pattern without ``*`` is no longer than its words. Keys are
    found by their last letter, or by their length where a pattern leaves that open.
    """
    low = F.lower("pattern")
    tail = F.regexp_extract(low, r"([^*]*)$", 1)
    told = patterns.select("pattern").where("pattern is not null").distinct().select("pattern", tail.alias("_tail"), F.contains(low, F.lit("*")).alias("_open"))
    keys = index.select("key", "class_id", "form_id", "power").distinct()
    literal = (F.col("_tail") != "") & ~F.col("_tail").endswith("?")
    by_letter = keys.withColumn("_last", F.right("key", F.lit(1))).join(told.where(literal).withColumn("_last", F.right("_tail", F.lit(1))), "_last").drop("_last")
    sizes = F.explode(F.sequence(F.lit(1), F.lit(LONGEST)))
    by_size = keys.withColumn("_size", F.length("key")).join(told.where(~literal).withColumn("_size", sizes), "_size").drop("_size")
    both = F.least(F.length("key"), F.length("_tail"))
    found = by_letter.unionByName(by_size).where(F.col("_open") | (F.length("key") <= F.length("_tail")))
    found = found.withColumn("_end", F.right("key", both)).withColumn("_like", like_pattern(F.right("_tail", both)))
    return found.where(F.expr("_end like _like escape '\\\\'")).select("pattern", "key", "class_id", "form_id", "power")
