"""Mixing sources to target weights by entropy balancing, by built-in expressions only.

Documents get rates r that stay as close as possible, in relative entropy weighed by
size, to one copy each, subject to one token constraint per source:

    minimise  sum size * (r ln r - r + 1)   subject to  sum size * r = target.

The dual is convex: minimise  sum size * exp(lambda) - lambda * target  for each
source, whose solution tilts every document's rate exponentially, r = exp(lambda).
Newton's step needs the gradient and the curvature of each source. All documents of a
source share its multiplier, so that one aggregation over all documents, the sizes of the
sources, gives both for every step; the steps are taken where a source's row is, and
nothing is collected. There may be as many sources as documents: running sums over
sources are taken in ranges of sources, whose totals alone meet in one task.

Rates are rounded into whole copies. Within a source, documents are dealt into bins by
size class (powers of two) and a hash of their id; error diffusion over the bins, from
large sizes to small, decides which bins take one copy more, so that what a large bin
leaves over is made up by smaller ones. The bins of a source are at most
``CLASSES * bins``, however many documents it has.

Defined cases: a null text has size 0; a null source is a source of its own, the last;
documents of size 0 take 0 words; repeated rows count each; a null ``doc_id`` hashes
like any value; an empty table gives an empty table; other columns are kept, except that
``mixed`` puts its own in place of columns called size, source_size, target or copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.llm.shared import written

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most copies of a document.
SHARE, MOST = 1.5, 2
#: Columns that ``mixed`` adds, in place of any that have these names.
ADDED = ("size", "source_size", "target", "copies")
#: Hash bins of a size class, and size classes (sizes are below 2**62).
BINS, CLASSES = 128, 62


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    A source is full when its part of what the others leave reaches ``most`` times its
    size. In the order of size over weight the full sources come first, so running sums
    tell them.
    """
    spark = sizes.sparkSession
    one = F.lit(1).cast("double")
    named = prefix_sums(spark, sizes, [F.col("source").asc_nulls_last()], {"place": one})
    listed = F.array(*map(F.lit, map(float, weights)))
    ranked = named.select("source", "source_size", F.get(listed, ((F.col("place") - 1) % len(weights)).cast("int")).alias("w"))
    cap = most * F.col("source_size")
    summed = prefix_sums(spark, ranked.withColumn("ratio", F.col("source_size") / F.col("w")), [F.col("ratio").asc(), F.col("source").asc_nulls_last()], {"caps": cap, "weights": F.col("w")})
    every = summed.agg(F.sum("source_size").alias("words"), F.sum("w").alias("w")).first()
    words, weight = float(every["words"] or 0), float(every["w"] or 0)
    left, w_left = F.lit(share * words) - F.col("caps") + cap, F.lit(weight) - F.col("weights") + F.col("w")
    marked = summed.withColumn("full", left * F.col("w") >= cap * w_left)
    full = marked.where("full").agg(F.sum(cap).alias("caps"), F.sum("w").alias("w")).first()
    rest = weight - float(full["w"] or 0)
    level = (share * words - float(full["caps"] or 0)) / rest if rest else 0.0
    return marked.select("source", "source_size", F.when(F.col("full"), cap).otherwise(level * F.col("w")).cast("double").alias("target"))


def prefix_sums(spark: SparkSession, table: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the running sum of each column of ``sums`` in a total order, without a single task for all rows.

    Rows are dealt into ranges, which are written; each adds up its own rows and what the
    ranges before it add up to, a row a range.
    """
    valued = table.select("*", *[c.cast("double").alias(n) for n, c in sums.items()])
    ranged = written(spark, valued.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(n).alias(n) for n in sums])
    starts = totals.select("_range", *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = ranged.withColumns({n: F.sum(n).over(inside) for n in sums}).join(F.broadcast(starts), "_range")  # as many rows as partitions
    return both.select(*table.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def multipliers(goals: DataFrame, tolerance: float = 1e-12, steps: int = 50) -> DataFrame:
    """(source, source_size, target, rate): Newton's iterations on each source's dual, ended where a step is below the tolerance."""

    def newton(state: Column, _: Column) -> Column:
        tilted = F.col("source_size") * F.exp(state["at"])
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (tilted - F.col("target")) / tilted))
        moves = (state["moved"] > tolerance) & (F.col("source_size") > 0) & (F.col("target") > 0)
        return F.struct(F.when(moves, state["at"] - step).otherwise(state["at"]).alias("at"), F.when(moves, F.abs(step)).otherwise(F.lit(0.0)).alias("moved"))

    start = F.struct(F.lit(0.0).alias("at"), F.lit(1.0).alias("moved"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton, lambda state: state["at"])
    return goals.select("source", "source_size", "target", F.exp(solved).alias("rate"))


def _bin(bins: int) -> Column:
    """A document's bin within its source: large sizes first, then by hash."""
    size_class = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(0)
    return ((CLASSES - size_class) * bins + F.pmod(F.xxhash64("doc_id", "size"), F.lit(bins))).cast("int")


def plan(sizes: DataFrame, bins: int = BINS, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: source, source_size, target, whole copies of each document, and which bins take one more.

    ``sizes`` has doc_id, source, size and is read twice.
    """
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rates = multipliers(goals).withColumn("rate", F.least("rate", F.lit(float(most))))
    # a rate a rounding error below a whole number counts as that number
    rates = rates.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    filled = sizes.groupBy("source", _bin(bins).alias("bin")).agg(F.sum("size").alias("words")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("bin", "words"))).alias("bins"))

    def diffuse(acc: Column, x: Column) -> Column:
        owed = acc["owed"] + F.col("part") * x["words"]
        take = (x["words"] > 0) & (owed * 2 >= x["words"])
        return F.struct(
            F.when(take, owed - x["words"]).otherwise(owed).alias("owed"),
            F.concat(acc["bits"], F.repeat(F.lit("0"), x["bin"] - F.length(acc["bits"])), F.when(take, "1").otherwise("0")).alias("bits"),
        )

    start = F.struct(F.lit(0.0).alias("owed"), F.lit("").alias("bits"))
    return rates.join(filled.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "source_size", "target", F.col("whole").cast("int").alias("whole"), F.aggregate("bins", start, diffuse, lambda acc: acc["bits"]).alias("bits")
    )


def mixed(docs: DataFrame, text: str = "text", bins: int = BINS, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds size, source_size, target and copies; a document is meant to stand ``copies`` times in the mix."""
    spark = docs.sparkSession
    sizes = written(spark, sized(docs.select("doc_id", "source", text), text).select("doc_id", "source", "size"), "sizes", packed=True)
    # the plan has a row a source; written, so that its size is known where it is joined
    chosen = written(spark, plan(sizes, bins, weights, share, most), "mix").withColumnRenamed("source", "of")
    extra = F.substring("bits", _bin(bins) + 1, F.lit(1)) == "1"
    own = sized(docs.select(F.struct("*").alias("row"), "doc_id", "source", F.col(text).alias("text")))
    both = own.join(chosen, F.col("source").eqNullSafe(F.col("of")))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return both.select(*kept, "size", "source_size", "target", (F.col("whole") + extra.cast("int")).alias("copies"))


def mix_rows(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with its own columns, whatever they are called."""
    whole = docs.select("doc_id", "source", F.col(text).alias("text"), F.struct("*").alias("row"))
    return mixed(whole, "text", **options).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    got = mixed(docs)
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
