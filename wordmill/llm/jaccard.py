"""Exact Jaccard join of documents on word n-grams, and the groups that its links form.

Documents are compared by their sets of distinct n-gram hashes (64 bits). The join works
in size-banded tiles with bitmap signatures:

1. Texts with equal sets fall into one class; the smallest doc_id stands for it.
2. A class's prefix is the part of its set, rare n-grams first, that any set similar
   enough must meet (n - ceil(threshold n) + 1 of n). A tile holds the classes whose
   prefixes meet in one n-gram, in the order of their sizes, so that only a band of
   sizes, from threshold to 1, is compared. The order of n-grams is by hash, but
   n-grams that very many documents share come last, the most frequent at the end.
   Any one order gives exact results; this one keeps tiles small.
   Large tiles (over ``SMALL`` classes) with the same smallest class are put together,
   cut into bands of sizes and those into blocks of ``BLOCK`` classes.
3. A pair of a tile goes on if the counts of bits in which the hashed bitmaps of both
   sets differ leave room for the overlap that it needs: |A & B| <= (|A| + |B| - bits) / 2.
4. What is left is compared exactly, on sorted arrays of hashes.

A group of g near copies would give g * g / 2 pairs in every tile it meets in. So a
first round links each class only to the smallest class with which it shares a minimum
of its set (a star of a few links a class), exactly compared as above. The second
round, over all tiles, leaves out pairs that these links already connect. In a large
tile the classes of its largest group meet only those outside it, not each other; steps
3 and 4 happen inside the block, and only a spanning forest of the links found leaves
it, at most one link a class. What links connect is the result, so no link between
different groups is lost.

Frequent n-grams are found by counts over all documents. Every ``COUNTED`` n-grams, a task
reports those that it has at least twice, so a count may be short by one each time; only the order of
n-grams, never a result, depends on it. The frequent n-grams that are broadcast are at
most ``HOT`` (2 MB); where there are more, those with larger counts are taken.

Defined cases: a null text and one without words have an empty set and link with
nothing; fewer words than n make one n-gram of all; repeated rows of a doc_id are rows
of one class if their texts agree; rows that share a doc_id but not a text are compared
each by its own text and belong to one group; a null doc_id keeps its row, with a null component, and links with
nothing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import blocks
from wordmill.llm.shared import components, dropped, modest, released, spread_join, written

#: Words of an n-gram, and the threshold as a fraction: 100 * intersection >= 80 * union.
WORDS, PART, WHOLE = 5, 80, 100
#: n-grams counted as frequent at most, and the least count of one.
HOT, HOT_LEAST = 1 << 18, 16
#: n-grams that are counted before those that occur once are set aside.
COUNTED = 1 << 23
#: Keys of the first round for each class, and n-grams of prefixes that a bucket of tiles holds on average.
STARS, BUCKET = 8, 400_000
#: Classes of a tile that is compared at once, and of a block of a larger one.
SMALL, BLOCK = 64, 512
#: n-grams of the sets of a block, on average.
BLOCK_GRAMS = 1 << 21
#: Bits of the filter of doc_ids that need their sets; a full filter lets all pass, to the join behind it.
FILTER_BITS = 1 << 23

FEATURES = "doc_id long, n long, set_a long, set_b long, stars array<long>, prefix array<long>, bits binary"


def _texts(batch: pa.RecordBatch) -> tuple[list, list]:
    return batch.column("doc_id").to_pylist(), blocks.encoded(batch.column("text"))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def frequent(docs: DataFrame, k: int, most: int, least: int) -> np.ndarray:
    """Hashes of the n-grams that most documents share, the most frequent last."""

    @blocks.frugal
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reported(sets: list[np.ndarray]) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(_signed(found[n > 1])), pa.array(n[n > 1])], ["h", "n"])

        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for s in blocks.shingle_sets(blocks.encoded(batch.column("text")), k):
                sets.append(s)
                held += len(s)
                if held >= COUNTED:
                    yield reported(sets)
                    sets, held = [], 0
        if sets:
            yield reported(sets)

    spark = docs.sparkSession
    counts = written(spark, docs.select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "frequent")
    # how many n-grams have each count to within a power of sqrt(2): a few dozen rows
    step = F.floor(F.log2(F.col("n").cast("double")) * 2)
    total = 0
    floor = None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if total + r["count"] > most:
            break
        total, floor = total + r["count"], r["step"]
    rows = counts.where(step >= floor).toArrow() if floor is not None else None
    dropped(spark, counts)
    if rows is None:
        return np.zeros(0, np.uint64)
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    return h[np.lexsort((h, n))]


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit for each hash, in as many bits as hold the set sparsely: a power of two, 64 at least."""
    width = 64
    while width < 8 * len(hashes):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(hashes >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the number of hashes in one set only; the wider bitmap is folded to the other's width."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def features(docs: DataFrame, k: int, part: int, whole: int, hot: np.ndarray) -> DataFrame:
    """For every document: set size, digest of the set, keys of the first round, prefix and bitmap."""
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    @blocks.frugal
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            ids, texts = _texts(batch)
            out: list[list] = [[] for _ in range(7)]
            for doc_id, s in zip(ids, blocks.shingle_sets(texts, k)):
                n = len(s)
                stars, prefix = s[:0], s[:0]
                if n:
                    place = np.searchsorted(known, s)
                    place[place == len(known)] = 0
                    common = known[place] == s if len(known) else np.zeros(n, bool)
                    rare = s[~common]
                    ordered = np.concatenate([rare, s[common][np.argsort(rank[place[common]])]]) if len(known) else rare
                    prefix = ordered[: n - (part * n + whole - 1) // whole + 1]
                    stars = minima(rare if len(rare) else s)
                for column, x in zip(out, (doc_id, n, int(blocks.mix(s * np.uint64(3)).sum(dtype=np.uint64).view(np.int64)) if n else 0, int(np.bitwise_xor.reduce(blocks.mix(s + np.uint64(11))).view(np.int64)) if n else 0, _signed(stars), _signed(prefix), bitmap(s))):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "n", "set_a", "set_b", "stars", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(made, FEATURES)


def minima(s: np.ndarray) -> np.ndarray:
    """Keys that similar sets are likely to share: least hashes of 2 * STARS parts of the hash space, in pairs."""
    parts = 2 * STARS
    x = blocks.mix(s)
    least = np.full(parts, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (s & np.uint64(parts - 1)).astype(np.int64), x)
    return blocks.mix(least[::2] * np.uint64(7) + least[1::2] + np.arange(STARS, dtype=np.uint64))


def roomy(pairs: DataFrame, feats: DataFrame, part: int, whole: int) -> DataFrame:
    """Of pairs(a, b), those whose sizes and bitmaps leave room for the overlap they need."""

    @blocks.frugal
    def room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                (whole + part) * (na + nb - differing(x, y)) >= 2 * part * (na + nb)
                for na, nb, x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("xa").to_pylist(), batch.column("xb").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: feats.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}")).dropDuplicates([c])
    left = pairs.join(side("a"), "a").join(side("b"), "b").where(whole * F.least("na", "nb") >= part * F.greatest("na", "nb"))
    return written(feats.sparkSession, left.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(room, "a long, b long"), "room", packed=True)


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, hashes): the sorted set of every document in ``ids``, as bytes."""
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    marks = ids.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    # a fixed number of bits says which documents may be needed; the join below decides
    filled = spark.createDataFrame([(r["bucket"], bytearray(r["bits"])) for r in marks], "bucket long, bits binary")
    own = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    spot = F.bitmap_bit_position(own)
    needed = (
        docs.select("doc_id", "text", F.bitmap_bucket_number(own).alias("bucket"), spot.alias("spot"))
        .join(F.broadcast(filled), "bucket")
        .where(F.expr("conv(hex(substring(bits, cast(spot div 8 + 1 as int), 1)), 16, 10)").cast("int").bitwiseAND(F.expr("shiftleft(1, cast(spot % 8 as int))")) != 0)
        .select("doc_id", "text")
    )

    @blocks.frugal
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = _texts(batch)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([s.tobytes() for s in blocks.shingle_sets(texts, k)], pa.binary())], ["id", "hashes"])

    sets = needed.mapInArrow(packed, "id long, hashes binary").join(ids, "id", "left_semi").dropDuplicates(["id"])
    return written(spark, sets, "sets")


def alike(x: np.ndarray, y: np.ndarray, part: int, whole: int) -> bool:
    """Whether two sorted sets are similar enough."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and whole * both >= part * (len(x) + len(y) - both)


def similar(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Of pairs(a, b), those similar enough, compared exactly."""

    @blocks.frugal
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist())
            keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), part, whole) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}"))
    return written(pairs.sparkSession, pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ha", "hb").mapInArrow(compared, "a long, b long"), "similar")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def tiles(feats: DataFrame, group: DataFrame, part: int, whole: int, buckets: int) -> DataFrame:
    """Pairs(a, b) of classes of different groups whose prefixes meet in an n-gram and whose sizes are in one band."""

    @blocks.frugal
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            lengths = np.diff(lists.offsets.to_numpy())
            keys = lists.flatten().to_numpy().view(np.uint64)
            if not len(keys):
                continue
            repeat = lambda c: np.repeat(batch.column(c).to_numpy(), lengths)
            ids, n, groups = repeat("doc_id"), repeat("n"), repeat("component_id")
            home = (blocks.mix(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[order])) + 1
            rows = [(int(home[x[0]]), keys[x].astype(np.uint32).tobytes(), ids[x].tobytes(), (ids[x] - groups[x]).tobytes(), n[x].astype(np.uint32).tobytes()) for x in np.split(order, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], ["bucket", "keys", "ids", "gaps", "sizes"])

    @blocks.frugal
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {"keys": [], "ids": [], "gaps": [], "sizes": []}
        for batch in batches:
            for c, kind in (("keys", np.uint32), ("ids", np.int64), ("gaps", np.int64), ("sizes", np.uint32)):
                columns[c] += [np.frombuffer(x, kind) for x in batch.column(c).to_pylist()]
        keys, ids, gaps, sizes = (np.concatenate(columns[c]) for c in ("keys", "ids", "gaps", "sizes"))
        sizes = sizes.astype(np.int64)
        groups = ids - gaps
        order = np.lexsort((ids, sizes, keys))
        keys, ids, groups, sizes = keys[order], ids[order], groups[order], sizes[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        mixed = np.flatnonzero(np.minimum.reduceat(groups, starts) != np.maximum.reduceat(groups, starts))
        held: list[np.ndarray] = []
        count = 0
        for i in mixed.tolist():
            s, e = int(starts[i]), int(ends[i])
            if e - s > SMALL:
                held.append(np.stack([np.full(e - s, ids[s:e].min()), ids[s:e], np.ones(e - s, np.int64)]))
                count += e - s
                continue
            g, z, d = groups[s:e], sizes[s:e], ids[s:e]
            last = np.searchsorted(z, z * whole // part, side="right")
            for j in range(e - s - 1):
                to = int(last[j])
                other = np.flatnonzero(g[j + 1 : to] != g[j]) + j + 1
                if len(other):
                    held.append(np.stack([np.minimum(d[j], d[other]), np.maximum(d[j], d[other]), np.zeros(len(other), np.int64)]))
                    count += len(other)
                    if count > 1_000_000:
                        yield _pairs(held)
                        held, count = [], 0
        if held:
            yield _pairs(held)

    dealt_rows = feats.join(group, "doc_id").select("doc_id", "n", "component_id", "prefix").mapInArrow(dealt, "bucket long, keys binary, ids binary, gaps binary, sizes binary")
    return dealt_rows.groupBy("bucket").applyInArrow(met, "a long, b long, large long").distinct()


def banded(members: DataFrame, sets: DataFrame, feats: DataFrame, group: DataFrame, part: int, whole: int) -> DataFrame:
    """Links(a, b) that span what is similar in large tiles, given as members(lead, doc_id).

    The classes of a tile's largest group are compared with those outside it only; any
    others with all but their own group. Every pair of blocks is a task of its own.
    """
    spark = feats.sparkSession
    ratio = whole / part
    own = feats.select("doc_id", "n", "bits").dropDuplicates(["doc_id"]).join(group, "doc_id").join(members, "doc_id").join(sets, F.col("doc_id") == F.col("id"))
    own = own.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(ratio)) + 1e-9)).drop("id")
    own = written(spark, own, "members")
    again = spark.read.schema(own.schema).parquet(own._wordmill_path)  # a cogroup's sides need columns of their own
    main = own.groupBy("lead", "component_id").count().groupBy("lead").agg(F.max_by("component_id", F.struct("count", "component_id")).alias("main"))
    outside = own.join(main, "lead").where(F.col("component_id") != F.col("main"))
    near = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int")
    # a tile has outsiders of one band on the left, and all of this band and its neighbours on the right
    tile = outside.groupBy("lead", F.col("band").alias("tile")).agg(parts.alias("p"))
    wide = own.select("lead", "n", near.alias("tile")).groupBy("lead", "tile").agg(parts.alias("q"))
    tile = written(spark, tile.join(wide, ["lead", "tile"]), "blocks")
    spot = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["lead", "tile", "i", "j", "doc_id", "n", "bits", "component_id", "hashes"]
    left = outside.withColumn("tile", F.col("band")).join(tile, ["lead", "tile"]).withColumn("i", spot("p")).withColumn("j", every("q")).select(columns)
    right = again.withColumn("tile", near).join(tile, ["lead", "tile"]).withColumn("i", every("p")).withColumn("j", spot("q")).select(columns)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return spanning(left, right, part, whole)

    key = ["lead", "tile", "i", "j"]
    links = written(spark, left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "a long, b long"), "large")
    dropped(spark, own, tile)
    return links


def spanning(left: pa.Table, right: pa.Table, part: int, whole: int) -> pa.Table:
    """Links(a, b) between a block's sides: a spanning forest of all pairs that are similar, beyond the groups known before."""
    a: list[int] = []
    b: list[int] = []
    if left.num_rows and right.num_rows:
        x, y = ([np.frombuffer(bits, np.uint8) for bits in t.column("bits").to_pylist()] for t in (left, right))
        width = min(map(len, x + y))
        x, y = (np.stack([np.bitwise_or.reduce(bits.reshape(-1, width), axis=0) for bits in z]).view(np.uint64) for z in (x, y))
        mine, theirs = (t.column("hashes").to_pylist() for t in (left, right))
        ids, n = (right.column(c).to_numpy() for c in ("doc_id", "n"))
        # groups of this block, as numbers: they grow together as links are found
        both = np.concatenate([t.column("component_id").to_numpy() for t in (left, right)])
        group = np.unique(both, return_inverse=True)[1]
        mine_in, theirs_in = group[: left.num_rows], group[left.num_rows :]
        for k, (doc_id, size) in enumerate(zip(left.column("doc_id").to_pylist(), left.column("n").to_pylist())):
            at = np.flatnonzero((theirs_in != mine_in[k]) & (whole * np.minimum(n, size) >= part * np.maximum(n, size)))
            differ = np.bitwise_count(y[at] ^ x[k]).sum(axis=1, dtype=np.int64)
            at = at[(whole + part) * (n[at] + size - differ) >= 2 * part * (n[at] + size)]
            own = np.frombuffer(mine[k], np.uint64)
            for j in at.tolist():
                if theirs_in[j] != mine_in[k] and alike(own, np.frombuffer(theirs[j], np.uint64), part, whole):
                    a.append(doc_id)
                    b.append(int(ids[j]))
                    group[group == theirs_in[j]] = mine_in[k]  # both sides are views of this array
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(held, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["a", "b", "large"])


def groups(docs: DataFrame, k: int = WORDS, part: int = PART, whole: int = WHOLE, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Documents link when whole * |A & B| >= part * |A | B|. Each text of a doc_id that has
    several is a document of its own here, named by a hash; doc_ids tie their groups.
    """
    spark = docs.sparkSession
    modest(spark)
    docs = docs.select("doc_id", "text")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select(F.col("doc_id").alias("of"))
    several = written(spark, several, "several")
    if several.isEmpty():
        return _groups(docs, k, part, whole, hot)
    # nothing bounds the doc_ids with several texts, so they are never broadcast
    own = docs.hint("merge").join(several, docs["doc_id"] == several["of"], "left")
    name = F.when(F.col("of").isNotNull(), F.xxhash64("doc_id", text)).otherwise(F.col("doc_id"))
    named = written(spark, own.select("doc_id", name.alias("name"), "text"), "named")
    found = written(spark, _groups(named.select(F.col("name").alias("doc_id"), "text"), k, part, whole, hot).distinct(), "found")
    found = found.select(F.col("doc_id").alias("name"), "n_shingles", "component_id")
    rows = named.select("doc_id", "name")
    # equal rows have equal findings; rows without an id only have their set's size
    known = rows.where("doc_id is not null").join(found, "name")
    known = written(spark, known.select("doc_id", "n_shingles", "component_id"), "known")
    first = known.groupBy("doc_id").agg(F.min("component_id").alias("least"))
    tied = components(spark, known.join(first, "doc_id").select(F.col("component_id").alias("a"), F.col("least").alias("b")))
    whole_groups = known.join(tied, known["component_id"] == tied["id"], "left").select("doc_id", F.coalesce(tied["component_id"], known["component_id"]).alias("group"), "n_shingles")
    whole_groups = written(spark, whole_groups, "whole")
    least = whole_groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = whole_groups.join(least, "group").select("doc_id", "n_shingles", "component_id")
    return out.union(_groups_without_id(docs, k))


def _groups_without_id(docs: DataFrame, k: int) -> DataFrame:
    """The rows of ``groups`` for the rows that have no doc_id."""

    @blocks.frugal
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = _texts(batch)
            sizes = [len(s) for s in blocks.shingle_sets(texts, k)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return docs.where("doc_id is null").mapInArrow(sized, "doc_id long, n_shingles long, component_id long")


def _groups(docs: DataFrame, k: int, part: int, whole: int, hot: int) -> DataFrame:
    """``groups`` of rows of which no doc_id has several texts."""
    spark = docs.sparkSession
    feats = written(spark, features(docs, k, part, whole, frequent(docs, k, hot, HOT_LEAST)), "features")
    sets = feats.where("n > 0 and doc_id is not null")
    # a class: documents with equal sets; a doc_id in several classes ties them together below
    classes = written(spark, sets.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    member = written(spark, spread_join(sets.select("doc_id", "n", "set_a", "set_b"), classes, ["n", "set_a", "set_b"], "copies").select("doc_id", "rep").distinct(), "members")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    released(spark)

    keys = written(spark, sets.select("doc_id", "stars").join(reps, "doc_id", "left_semi").select("doc_id", F.explode("stars").alias("key")), "keys")
    leaders = written(spark, keys.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1"), "leaders", packed=True)
    first = spread_join(keys, leaders, ["key"], "m").where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = roomy(written(spark, first, "stars"), sets, part, whole)
    dropped(spark, keys, leaders)
    arrays = sets_of(docs, ends(pairs).distinct(), k)
    near = similar(pairs, arrays, part, whole)
    dropped(spark, pairs, arrays)
    tied = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    so_far = components(spark, near)
    group = reps.join(so_far, reps["doc_id"] == so_far["id"], "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    group = written(spark, group, "groups")

    total = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    rest = written(spark, tiles(sets, group, part, whole, max(48, total // BUCKET)), "tiles")
    released(spark)
    members = rest.where("large = 1").select(F.col("a").alias("lead"), F.col("b").alias("doc_id"))
    pairs = roomy(rest.where("large = 0").select("a", "b"), sets, part, whole)
    arrays = sets_of(docs, ends(pairs).union(members.select("doc_id")).distinct(), k)
    more = similar(pairs, arrays, part, whole).union(banded(members, arrays, sets, group, part, whole))
    dropped(spark, pairs, arrays)
    released(spark)
    found = components(spark, near.union(more).union(tied))
    out = feats.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(found, out["doc_id"] == found["id"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and group."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stand for their group (the smallest doc_id), all others dropped; rows without an id stay."""
    found = groups(docs).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    # nothing bounds what goes, so it is never broadcast, however little it is
    return docs.hint("merge").join(found, docs["doc_id"] == found["gone"], "left_anti")
