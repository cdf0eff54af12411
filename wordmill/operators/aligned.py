"""The difference of two ordered tables of lines, as edits between lines that stay.

1. Anchors: lines that stand once on each side. Of these a longest chain is kept whose places
   rise on both sides. Anchors that follow each other on both sides are one run, and stay or
   go together; runs that nothing crosses stay; runs that cross each other, directly or
   through others, are one component, of which a task finds the heaviest rising runs.
2. Anchors cut both sides into segments. What follows an anchor, or stands before the next
   one, and is equal line by line on both sides stays as well, repeated lines too.
3. Of what is left in a segment, lines that both sides have keep a longest common
   subsequence. One task finds it in segments of at most ``PAIRS`` pairs of equal lines; in
   longer ones it is made of blocks of lines (``_by_blocks``), with the same length.
4. All other old lines are removed, all other new ones added.

So the listing between two anchors is a shortest one. Over all it can be longer than a shortest
one where anchors cross repeated lines that moved the other way.

The old lines without the removed ones are the new lines without the added ones, in order
(tested). Lines get numbers by one sort and sums over ranges; a task holds a range, a block
with the lines it is compared with, or the runs of a component, and segments are compared by
joins on segment and offset, so a long segment is many keys. The work of blocks grows with the
product of a segment's sides, at 64 pairs of lines a step; ``BANDS`` bounds its rounds.
"""

from __future__ import annotations

import bisect
import functools
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.sources.files import written as _written

#: Lines of a range; pairs of equal lines that a task lists; lines of a block at least; blocks of a side at most.
RANGE, PAIRS, BLOCK, BANDS = 1 << 16, 1 << 20, 1 << 15, 16
EARLIER = (Window.unboundedPreceding, -1)


def ranked(table: DataFrame) -> DataFrame:
    """rank, line of lines(place, line): places as numbers from 0 on, without gaps. Lines of one place stand in their own order."""
    cut = _written(table.select("place", F.coalesce("line", F.lit("")).alias("line")).orderBy("place", "line").withColumn("part", F.spark_partition_id()))
    counts = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("place", "line")) - 1
    return _written(cut.withColumn("within", within).join(base, "part").select((F.col("base") + F.col("within")).alias("rank"), "line"))


def longest_rising(numbers: list[int]) -> list[int]:
    """The positions of a longest rising subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(numbers)
    for i, x in enumerate(numbers):
        k = bisect.bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
            at.append(i)
        else:
            ends[k], at[k] = x, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def heaviest_rising(numbers: list[int], weights: list[int]) -> list[int]:
    """The positions of a rising subsequence of ``numbers``, which are unlike each other, with the greatest sum of ``weights``."""
    ends: list[int] = []  # rising, and so are the greatest sums of chains that end there
    sums: list[int] = []
    at: list[int] = []
    before = [-1] * len(numbers)
    for i, (x, weight) in enumerate(zip(numbers, weights)):
        k = bisect.bisect_left(ends, x)
        total = weight + (sums[k - 1] if k else 0)
        before[i] = at[k - 1] if k else -1
        beaten = bisect.bisect_right(sums, total, lo=k)
        ends[k:beaten], sums[k:beaten], at[k:beaten] = [x], [total], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _numbered(table: DataFrame, by: str, size: int, name: str, group: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``name``: numbers from 0 on in the order of ``by``, in each ``group``, by sums over ranges."""
    cut = table.withColumn("range", F.floor(F.col(by) / size))
    counts = cut.groupBy(*group, "range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    base = counts.select(*group, "range", F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("range").rowsBetween(*EARLIER)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy(*group, "range").orderBy(by)) - 1
    return cut.withColumn("within", within).join(base, [*group, "range"]).withColumn(name, F.col("base") + F.col("within")).drop("range", "within", "base")


def _greatest(table: DataFrame, value, name: str, last: int) -> DataFrame:
    """``table`` (range, i) with ``name``: the greatest ``value`` of the rows before, in the order of i, with the row itself if ``last`` is 0."""
    ends = table.groupBy("range").agg(F.max(value).alias("most"))  # a row for each range
    carried = ends.select("range", F.max("most").over(Window.orderBy("range").rowsBetween(*EARLIER)).alias("carried"))
    here = F.max(value).over(Window.partitionBy("range").orderBy("i").rowsBetween(Window.unboundedPreceding, last))
    return table.withColumn(name, here).join(carried, "range").withColumn(name, F.greatest(name, "carried")).drop("carried")


def _heaviest(rows):
    """The runs(range, run, i, j, n) of one component that its heaviest rising chain keeps."""
    import pyarrow as pa

    rows = rows.sort_by("i")
    kept = heaviest_rising(rows.column("j").to_pylist(), rows.column("n").to_pylist())
    return rows.take(pa.array(kept, pa.int64())).select(["range", "run"])


def anchors(old: DataFrame, new: DataFrame, size: int = RANGE) -> DataFrame:
    """a, b: the ranks of a longest chain of lines that stand once on each side, rising on both."""
    once = lambda t, c: t.groupBy("line").agg(F.min("rank").alias(c), F.count(F.lit(1)).alias("n")).where("n = 1").select(F.xxhash64("line").alias("h"), "line", c)
    pairs = _written(once(old, "a").join(once(new, "b"), ["h", "line"]).select("a", "b"))
    both = _numbered(_numbered(pairs, "a", size, "i"), "b", size, "j").withColumn("range", F.floor(F.col("i") / size))
    here = Window.partitionBy("range").orderBy("i")
    heads = both.withColumn("head", F.coalesce((F.col("j") - F.lag("j").over(here) != 1).cast("long"), F.lit(1)))
    both = _written(heads.withColumn("run", F.sum("head").over(here.rowsBetween(Window.unboundedPreceding, 0))).drop("head"))
    runs = _written(both.groupBy("range", "run").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count(F.lit(1)).alias("n")))
    # where all numbers below i stand before, a component starts; a run that stands in its own place there is alone
    starts = _written(_greatest(runs, F.col("j") + F.col("n") - 1, "top", -1).withColumn("start", F.coalesce("top", F.lit(-1)) == F.col("i") - 1))
    crossing = _greatest(starts, F.when(F.col("start"), F.col("i")), "component", 0).where("not (start and j = i)")
    kept = starts.where("start and j = i").select("range", "run").unionByName(crossing.groupBy("component").applyInArrow(_heaviest, "range long, run long"))
    return both.join(kept, ["range", "run"], "left_semi").select("a", "b")


def _segmented(lines: DataFrame, at: DataFrame, size: int) -> DataFrame:
    """rank, line, anchor, segment, start: how many anchors(rank) stand at or before a line, and the rank of the last of them (-1 if none)."""
    own = lines.join(at.select("rank", F.lit(True).alias("anchor")), "rank", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False))).withColumn("range", F.floor(F.col("rank") / size))
    sums = own.groupBy("range").agg(F.sum(F.col("anchor").cast("long")).alias("n"), F.max(F.when(F.col("anchor"), F.col("rank"))).alias("last"))  # a row for each range
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("from"))
    here = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    told = own.join(carried, "range")
    segment = F.col("base") + F.sum(F.col("anchor").cast("long")).over(here)
    start = F.coalesce(F.max(F.when(F.col("anchor"), F.col("rank"))).over(here), F.col("from"))
    return told.select("rank", "line", "anchor", segment.alias("segment"), start.alias("start"))


def _agreeing(old: DataFrame, new: DataFrame, offset: str) -> DataFrame:
    """segment, first: the least offset at which a segment's sides differ; none where they agree to the end."""
    left, right = old.select("segment", offset, F.col("line").alias("x")), new.select("segment", offset, F.col("line").alias("y"))
    both = left.join(right, ["segment", offset], "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).groupBy("segment").agg(F.min(offset).alias("first"))


def _sweep(rows: list, cols: list, bits: int | None = None, carries: bytes | None = None) -> tuple[int, bytes]:
    """A block of the table of common subsequences: a bit for each of ``cols``, 0 where the length rises below the last of ``rows``.

    ``bits`` are those above the first row (all 1 at the top). ``carries`` tell for each row whether
    the length rises left of the block; those on its right are returned. This is the addition of
    long numbers of Crochemore et al., and a block is a digit of it.
    """
    width = len(cols)
    full = (1 << width) - 1
    bits = full if bits is None else bits
    places: dict = {}
    for j, y in enumerate(cols):
        places.setdefault(y, []).append(j)

    @functools.lru_cache(maxsize=max(64, (1 << 29) // (width + 1)))  # 64 MB
    def equal(x) -> int:
        own = np.zeros(width, np.uint8)
        own[places[x]] = 1
        return int.from_bytes(np.packbits(own, bitorder="little").tobytes(), "little")

    out = bytearray(len(rows))
    for i, x in enumerate(rows):
        carry = carries[i] if carries else 0
        if x in places:
            met = bits & equal(x)
        elif carry:
            met = 0
        else:
            continue
        total = bits + met + carry
        out[i] = total >> width
        bits = (total & full) | (bits - met)
    return bits, bytes(out)


def _rises(bits: bytes, width: int) -> np.ndarray:
    """1 for each column where the length rises."""
    return 1 - np.unpackbits(np.frombuffer(bits, np.uint8), count=width, bitorder="little").astype(np.int64)


def _packed(bits: int, width: int) -> bytes:
    return bits.to_bytes((width + 7) // 8, "little")


def _cut(ahead: np.ndarray, back: np.ndarray) -> int:
    """The first column at which a longest common subsequence may go from the upper rows to the lower ones, from where their lengths rise."""
    return int(np.argmax(np.concatenate(([0], np.cumsum(ahead))) + back.sum() - np.concatenate(([0], np.cumsum(back)))))


def common(old: list, new: list, most: int = PAIRS) -> list[tuple[int, int]]:
    """The places of a longest common subsequence: by a rising run of the pairs of equal lines, where these are more than ``most`` in halves."""
    out, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(old[a:b]), Counter(new[c:d])
        if b - a == 1 or sum(n * right[x] for x, n in left.items()) <= most:
            here: dict = {}
            for j in range(d - 1, c - 1, -1):
                here.setdefault(new[j], []).append(j)
            # an old line's places on the new side fall, so that it takes one of them at most
            pairs = [(i, j) for i in range(a, b) for j in here.get(old[i], ())]
            out.extend(pairs[k] for k in longest_rising([j for _, j in pairs]))
            continue
        half, width = (a + b) // 2, d - c
        ahead, _ = _sweep(old[a:half], new[c:d])
        back, _ = _sweep(old[half:b][::-1], new[c:d][::-1])
        at = c + _cut(_rises(_packed(ahead, width), width), _rises(_packed(back, width), width)[::-1])
        todo += [(a, half, c, at), (half, b, at, d)]
    return sorted(out)


def _common(most: int):
    """The rows(side, rank, line) of one group that a longest common subsequence keeps."""

    def kept(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        old, new = (rows.filter(pc.equal(rows.column("side"), side)).sort_by("rank") for side in ("<<", ">>"))
        at = common(old.column("line").to_pylist(), new.column("line").to_pylist(), most)
        stay = [t.take(pa.array(own, pa.int64())).select(["side", "rank"]) for t, own in zip((old, new), zip(*at) if at else ((), ()))]
        return pa.concat_tables(stay)

    return kept


def _swept(batches):
    """segment, back, x, y, the lengths' rises below a block (bits) and right of it (carries), and its columns (width)."""
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            rows, cols = (row[c][:: -1 if row["back"] else 1] for c in ("rows", "cols"))
            above = None if row["bits"] is None else int.from_bytes(row["bits"], "little")
            bits, carries = _sweep(rows, cols, above, row["carries"])
            done = {c: row[c] for c in ("segment", "back", "x", "y")} | {"bits": _packed(bits, len(cols)), "carries": carries, "width": len(cols)}
            yield pa.RecordBatch.from_pylist([done], pa.schema([("segment", pa.int64()), ("back", pa.bool_()), ("x", pa.int64()), ("y", pa.int64()), ("bits", pa.binary()), ("carries", pa.binary()), ("width", pa.int64())]))


def _crossed(rows):
    """segment, cut: where the new side is cut for one boundary of the old side's blocks."""
    import pyarrow as pa

    rises: dict[bool, list] = {False: [], True: []}
    for row in rows.sort_by("column").select(["back", "bits", "width"]).to_pylist():
        rises[row["back"]].append(_rises(row["bits"], row["width"])[:: -1 if row["back"] else 1])
    return pa.table({"segment": rows.column("segment").slice(0, 1).combine_chunks(), "cut": pa.array([_cut(*(np.concatenate(rises[back]) for back in (False, True)))], pa.int64())})


def _walked(batches):
    """The state of ``_in_order`` after a pair of blocks, the block of the longer side it was in (before), and that one's lines which are met."""
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            long, short = row.pop("longer"), row.pop("shorter")
            p, q, met = row["p"], row["q"], []
            while p < len(long) and q < len(short):
                if long[p] == short[q]:
                    met.append(p)
                    q += 1
                p += 1
            row |= {"before": row["i"], "met": met}
            row |= {"i": row["i"] + 1, "p": 0} if p == len(long) else {"p": p}
            row |= {"j": row["j"] + 1, "q": 0} if q == len(short) else {"q": q}
            numbers = [(c, pa.int64()) for c in ("each", "far", "near", "i", "j", "p", "q", "before")]
            yield pa.RecordBatch.from_pylist([row], pa.schema([("segment", pa.int64()), ("long", pa.string()), ("short", pa.string()), *numbers, ("met", pa.list_(pa.int64()))]))


def _packed_lines(lines: DataFrame) -> DataFrame:
    array = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return _written(lines.groupBy("segment", "side", "block").agg(array.alias("lines")))


def _in_order(lines: DataFrame, each: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Of segments of which one side's lines all stand on the other side, in order: side, rank of what stays (all of the one side), and segment.

    Found by taking the next place of each line, a pair of blocks a round; sides of which each
    has more of some line are not tried. None if no segment is to be tried.
    """
    n = lambda side: F.count(F.when(F.col("side") == side, 1))
    counts = lines.groupBy("segment", "line").agg(n("<<").alias("a"), n(">>").alias("b")).groupBy("segment").agg(F.bool_and(F.expr("b <= a")).alias("less"), F.bool_and(F.expr("a <= b")).alias("more"))
    ways = counts.where("less or more").select("segment", F.expr("if(less, '<<', '>>')").alias("long"), F.expr("if(less, '>>', '<<')").alias("short"))
    long, short = each.select("segment", F.col("side").alias("long"), "each", F.col("blocks").alias("far")), each.select("segment", F.col("side").alias("short"), F.col("blocks").alias("near"))
    state = _written(ways.join(long, ["segment", "long"]).join(short, ["segment", "short"]).where("far > 1").select("*", *(F.lit(0).cast("long").alias(c) for c in "ijpq")))
    tasks = state.count()
    if not tasks:
        return None
    packed = _packed_lines(lines.join(state, "segment", "left_semi"))
    walked = []
    while not state.isEmpty():
        cells = state.select("segment", "long", "short", "each", "far", "near", "i", "j", "p", "q")
        cells = cells.join(packed.select("segment", F.col("side").alias("long"), F.col("block").alias("i"), F.col("lines").alias("longer")), ["segment", "long", "i"])
        cells = cells.join(packed.select("segment", F.col("side").alias("short"), F.col("block").alias("j"), F.col("lines").alias("shorter")), ["segment", "short", "j"])
        schema = "segment long, long string, short string, each long, far long, near long, i long, j long, p long, q long, before long, met array<long>"
        walked.append(_written(cells.repartition(tasks, "segment").mapInArrow(_walked, schema)))
        state = walked[-1].where("i < far and j < near")
    every = functools.reduce(DataFrame.unionByName, walked)
    done = _written(every.where("j = near").select("segment", F.col("short").alias("side")))
    met = every.select("segment", F.col("long").alias("side"), (F.col("before") * F.col("each")).alias("first"), F.explode("met").alias("at")).withColumn("at", F.col("first") + F.col("at"))
    met = lines.join(met.join(done.select("segment"), "segment", "left_semi"), ["segment", "side", "at"], "left_semi")
    return met.select("side", "rank").unionByName(lines.join(done, ["segment", "side"], "left_semi").select("side", "rank")), done.select("segment")


def _by_blocks(lines: DataFrame, most: int, size: int, block: int) -> DataFrame:
    """side, rank of the lines(segment, side, rank, line) that longest common subsequences keep, of segments of any length.

    Where one side's lines all stand on the other one in order, they are it (``_in_order``). Else both sides are cut into blocks, of ``block`` lines or a BANDSth of the side. The table of
    lengths is swept block by block from both of its ends, a diagonal of blocks a round; what its
    two sums say about each boundary between two blocks of old lines is the first column where
    a longest common subsequence may cross it. The first columns are all on one such, so the
    bands between them are compared each for itself.
    """
    lines = _written(_numbered(lines, "rank", size, "at", ("segment", "side")))
    each = lines.groupBy("segment", "side").agg(F.count(F.lit(1)).alias("n")).withColumn("each", F.greatest(F.lit(block), F.ceil(F.col("n") / BANDS)))
    each = _written(each.withColumn("blocks", F.ceil(F.col("n") / F.col("each"))))  # two rows for each segment
    lines = _written(lines.join(each.select("segment", "side", "each"), ["segment", "side"]).withColumn("block", F.floor(F.col("at") / F.col("each"))).drop("each"))
    kept = None
    if found := _in_order(lines, each):
        kept, done = found
        lines, each = (_written(t.join(done, "segment", "left_anti")) for t in (lines, each))
        if lines.isEmpty():
            return kept
    down, across = (each.where(F.col("side") == side).select("segment", F.col("blocks").alias(c)) for side, c in (("<<", "down"), (">>", "across")))
    grids = _written(down.where("down > 1").join(across, "segment"))
    most_of = grids.agg(F.max(F.col("down") + F.col("across") - 1).alias("rounds"), F.sum(2 * F.least("down", "across")).alias("tasks"), F.sum("down").alias("bands")).first()
    banded = lines.withColumn("band", F.when(F.col("side") == "<<", F.col("block")).otherwise(0))
    if most_of.rounds:
        packed = _packed_lines(lines.join(grids, "segment", "left_semi"))
        ways = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
        turned = lambda at, n: F.when(F.col("back"), F.col(n) - 1 - F.col(at)).otherwise(F.col(at))
        side = lambda side, n, at, c: packed.where(F.col("side") == side).join(grids, "segment").select("*", ways).select("segment", "back", turned("block", n).alias(at), F.col("lines").alias(c))
        rows, cols = side("<<", "down", "x", "rows"), side(">>", "across", "y", "cols")
        swept = []
        for i in range(most_of.rounds):
            cells = rows.withColumn("y", F.lit(i) - F.col("x")).join(cols, ["segment", "back", "y"])
            if swept:
                cells = cells.join(swept[-1].select("segment", "back", (F.col("x") + 1).alias("x"), "y", "bits"), ["segment", "back", "x", "y"], "left")
                cells = cells.join(swept[-1].select("segment", "back", "x", (F.col("y") + 1).alias("y"), "carries"), ["segment", "back", "x", "y"], "left")
            else:
                cells = cells.withColumn("bits", F.lit(None).cast("binary")).withColumn("carries", F.lit(None).cast("binary"))
            dealt = cells.select("segment", "back", "x", "y", "rows", "cols", "bits", "carries").repartition(most_of.tasks, "segment", "back", "x", "y")
            swept.append(_written(dealt.mapInArrow(_swept, "segment long, back boolean, x long, y long, bits binary, carries binary, width long")))
        told = functools.reduce(DataFrame.unionByName, swept).drop("carries").join(grids, "segment").withColumn("column", turned("y", "across"))
        told = told.withColumn("boundary", F.when(F.col("back"), F.col("down") - 1 - F.col("x")).otherwise(F.col("x") + 1)).where("boundary between 1 and down - 1")
        cuts = told.select("segment", "boundary", "back", "column", "bits", "width").groupBy("segment", "boundary").applyInArrow(_crossed, "segment long, cut long")
        cuts = cuts.groupBy("segment").agg(F.collect_list("cut").alias("cuts"))  # a row for each segment
        behind = F.size(F.filter("cuts", lambda c: c <= F.col("at")))
        banded = banded.join(cuts, "segment", "left").withColumn("band", F.when((F.col("side") == ">>") & F.col("cuts").isNotNull(), behind).otherwise(F.col("band")))
    dealt = banded.select("segment", "band", "side", "rank", "line").repartition(each.count() + (most_of.bands or 0), "segment", "band")
    compared = dealt.groupBy("segment", "band").applyInArrow(_common(most), "side string, rank long")
    return compared if kept is None else compared.unionByName(kept)


def _settled(both: DataFrame, most: int | None, pairs: int, size: int, block: int) -> DataFrame:
    """``both`` (segment, side, rank, line) without the lines that a segment's sides have in common, in order."""
    count = lambda side, c: both.where(F.col("side") == side).groupBy("segment", "line").agg(F.count(F.lit(1)).alias(c))
    shared = _written(count("<<", "a").join(count(">>", "b"), ["segment", "line"]).withColumn("key", F.monotonically_increasing_id()))
    sums = shared.groupBy("segment").agg(F.sum(F.col("a") * F.col("b")).alias("pairs"))
    sums = sums if most is None else sums.where(F.col("pairs") <= most)
    few, many = sums.where(F.col("pairs") <= pairs).select("segment"), _written(sums.where(F.col("pairs") > pairs).select("segment"))
    asked = both.join(shared.join(few, "segment", "left_semi"), ["segment", "line"], "left_semi")
    kept = asked.groupBy("segment").applyInArrow(_common(pairs), "side string, rank long")
    if not many.isEmpty():
        keys = shared.join(many, "segment", "left_semi").select("segment", "line", "key")  # a number takes the place of a line
        long = both.join(keys, ["segment", "line"]).select("segment", "side", "rank", F.col("key").alias("line"))
        kept = kept.unionByName(_by_blocks(_written(long), pairs, size, block))
    return both.join(kept, ["side", "rank"], "left_anti")


def edits(old: DataFrame, new: DataFrame, size: int = RANGE, most: int | None = None, pairs: int = PAIRS, block: int = BLOCK) -> DataFrame:
    """segment, side ('<<' removed or '>>' added), rank, line of two tables of lines(place, line).

    In the order of segment, side and rank they are a listing of all changes. A caller who would
    rather have a longer listing soon sets ``most``: segments of more pairs of equal lines are not
    compared. Without it all are. ``pairs`` and ``block`` bound what a task holds, not what it finds.
    """
    one, two = ranked(old), ranked(new)
    chain = _written(anchors(one, two, size))
    sides = [_written(_segmented(t, chain.select(F.col(c).alias("rank")), size)) for t, c in ((one, "a"), (two, "b"))]
    out = []
    rest = [t.where("not anchor").withColumn("offset", F.col("rank") - F.col("start")) for t in sides]
    differ = _written(_agreeing(*rest, "offset"))
    rest = [t.join(differ, "segment").where("offset >= first").drop("first") for t in rest]
    ends = []
    for t in sides:  # where a segment ends: at the next anchor, or behind the last line
        heads = t.where("anchor").select((F.col("segment") - 1).alias("segment"), F.col("rank").alias("end"))
        ends.append((heads, t.agg(F.coalesce(F.max("rank") + 1, F.lit(0)).alias("all"))))
    rest = [_written(t.join(heads, "segment", "left").join(F.broadcast(every), F.lit(True)).withColumn("back", F.coalesce("end", "all") - F.col("rank")).drop("end", "all")) for t, (heads, every) in zip(rest, ends)]
    differ = _agreeing(*rest, "back")
    for t, side in zip(rest, ("<<", ">>")):
        out.append(t.join(differ, "segment").where("back >= first").select("segment", F.lit(side).alias("side"), "rank", "line"))
    return _settled(_written(out[0].unionByName(out[1])), most, pairs, size, block).select("segment", "side", "rank", "line")
