"""Removal of runs of lines that stand earlier in the corpus, by winnowing over line hashes.

Lines are cut at line feeds and compared by two 64-bit hashes of their trimmed text;
blank lines are not counted. A run is repeated text if it has ``window`` lines, or fewer
that together have ``long_words`` words: so from each line on, a window is that line and
the next ones up to ``window`` lines, and also the shortest run that has ``long_words``
words, if that is shorter.

1. Winnowing: every window selects its line with the least hash (the last one, if several
   are least) as its fingerprint. Equal windows select the same place, so any repeated
   run is guaranteed to have a fingerprint in common. Only the selected fingerprints are
   shuffled, as counts that are summed up before.
2. Fingerprints that occur more than once are marked in a bitmap of a fixed size, which
   all tasks get. A second pass over the texts positions them: it gives the windows
   whose fingerprint is marked, with both hashes of all their lines. (A full bitmap lets
   more windows through; it never loses one.)
3. Positions are joined by the whole window, not by the bare fingerprint: the earliest
   place of each (by doc_id, then line) is a combinable minimum, so a passage that a third
   of all documents share is no list of positions anywhere. Windows that stand later
   overlap each other, which extends the match both ways as far as the lines agree.
4. Lines of later windows are deleted; the earliest occurrence stays. Only documents that
   a bitmap of the affected ones may name are shuffled to meet their deletions.

So a line goes exactly if it is in a window that occurs earlier.

Defined cases: a null text stays null; a text of which nothing is left becomes empty;
blank lines stay; rows with equal doc_id or a null one are told apart by a hash of their
text, and equal rows count as one document (all keep the same lines); an empty table
gives an empty table; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import blocks
from wordmill.llm.shared import bitmap_of, dropped, maybe_in, modest, released, spread_join, written

#: Lines of a window, and words that make a shorter run a passage.
WINDOW, LONG_WORDS = 3, 50
#: Bits of the bitmap of repeated fingerprints (8 MB).
MARK_BITS = 1 << 26

_TABS = re.compile(rb"[\t\r\x0b\f]+")


class _Lines:
    """The lines of a piece of texts that are not blank: text number, line number, two hashes, words."""

    def __init__(self, texts: list[bytes | None]):
        joined = _TABS.sub(b" ", b"\n".join(t or b"" for t in texts) + b"\n")
        data = np.frombuffer(joined, np.uint8)
        feeds = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], feeds[:-1] + 1])
        solid = (data != 32) & (data != 10)
        at = np.flatnonzero(solid)
        first, last = np.searchsorted(at, starts), np.searchsorted(at, feeds)
        full = last > first
        begin, end = at[first[full]], at[last[full] - 1] + 1
        heads = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        self.words = np.searchsorted(heads, end) - np.searchsorted(heads, begin)
        counts = np.fromiter((t.count(b"\n") + 1 if t else 1 for t in texts), np.int64, len(texts))
        text = np.repeat(np.arange(len(texts)), counts)
        self.line = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))[full]
        self.text = text[full]
        self.a, self.b = (blocks.slice_hashes(data, begin, end, base) for base in (blocks.FIRST, blocks.SECOND))

    def windows(self, window: int, long_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(lines, first line, selected line) of the windows of each length, as places among the lines."""
        n = len(self.text)
        sums = np.concatenate([[0], np.cumsum(self.words)])
        for size in range(1, window + 1):
            at = np.arange(max(n - size + 1, 0))
            at = at[self.text[at] == self.text[at + size - 1]]
            if size < window:  # the shortest run from its first line on that is long
                at = at[(sums[at + size] - sums[at] >= long_words) & (sums[at + size - 1] - sums[at] < long_words)]
            if len(at):
                chosen = at.copy()
                for i in range(1, size):
                    chosen = np.where(self.a[at + i] <= self.a[chosen], at + i, chosen)
                yield size, at, chosen

    def whole(self, hashes: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
        """A hash of all lines of windows, and of how many there are."""
        out = np.full(len(at), np.uint64(size))
        for i in range(size):
            out = blocks.mix(out * np.uint64(blocks.FIRST) + hashes[at + i])
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _fingerprints(texts: DataFrame, window: int, long_words: int) -> DataFrame:
    """mark, n: the hashes of selected lines, each place counted once; sums of a piece of texts."""

    @blocks.frugal
    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = blocks.encoded(batch.column("text"))
            for first, end in blocks.pieces(rows):
                own = _Lines(rows[first:end])
                places = [chosen for _, _, chosen in own.windows(window, long_words)]
                if places:
                    mark, n = np.unique(own.a[np.unique(np.concatenate(places))], return_counts=True)
                    yield pa.RecordBatch.from_arrays([_signed(mark), pa.array(n.astype(np.int64))], ["mark", "n"])

    return texts.select("text").mapInArrow(selected, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n"))


def _positions(texts: DataFrame, marked, window: int, long_words: int) -> DataFrame:
    """doc_id, digest, lines, whole_a, whole_b of every window whose fingerprint is marked."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(marked)
    kind = texts.schema["doc_id"].dataType.simpleString()

    @blocks.frugal
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = blocks.encoded(batch.column("text"))
            for first, end in blocks.pieces(rows):
                own = _Lines(rows[first:end])
                for size, at, chosen in own.windows(window, long_words):
                    kept = shared.value.has(own.a[chosen])
                    at = at[kept]
                    if not len(at):
                        continue
                    which = pa.array(own.text[at] + first)
                    lines = own.line[at[:, None] + np.arange(size)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).take(which) for c in ("doc_id", "digest")),
                            pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(at) + 1, size, np.int32)), pa.array(lines.ravel())),
                            *(_signed(own.whole(h, size, at)) for h in (own.a, own.b)),
                        ],
                        ["doc_id", "digest", "lines", "whole_a", "whole_b"],
                    )

    return texts.select("doc_id", "digest", "text").mapInArrow(placed, f"doc_id {kind}, digest long, lines array<int>, whole_a long, whole_b long")


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, digest, gone): for documents of which lines go, the numbers of those lines.

    ``digest`` is a hash of the text that tells rows with one doc_id apart.
    """
    spark = docs.sparkSession
    modest(spark)
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("digest"), "text")
    repeated = _fingerprints(texts, window, long_words).where("n > 1")
    marked = bitmap_of(repeated.select("mark"), MARK_BITS)
    found = written(spark, _positions(texts, marked, window, long_words), "windows")
    place = F.struct("doc_id", "digest", F.col("lines")[0].alias("line"))
    whole = ["whole_a", "whole_b"]
    first = found.groupBy(*whole).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last")
    first = written(spark, first.select(*whole, "first", "n"), "first")
    later = spread_join(found, first, whole).where(F.col("first") < place)
    gone = later.select("doc_id", "digest", F.explode("lines").alias("line")).distinct()
    gone = written(spark, gone.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list("line")).alias("gone")), "gone")
    dropped(spark, found, first)
    return gone


def without_repeats(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """``row`` (all columns of ``docs``), ``kept`` (the text without repeated runs of lines), n_lines and n_deleted."""
    spark = docs.sparkSession
    gone = repeated_lines(docs.select("doc_id", "text"), window, long_words)
    affected = bitmap_of(gone.select(F.xxhash64("doc_id")), MARK_BITS)
    released(spark)
    gone = gone.select(F.col("doc_id").alias("of"), F.col("digest").alias("as"), "gone")
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_lines = F.coalesce(feeds, F.lit(0)).cast("long").alias("n_lines")
    untouched = maybe_in(whole, F.col("doc_id"), affected, False).select("row", F.col("text").alias("kept"), n_lines, F.lit(0).cast("long").alias("n_deleted"))
    # nothing bounds the deletions, so they are never broadcast, however few they are
    touched = maybe_in(whole, F.col("doc_id"), affected, True).withColumn("digest", F.xxhash64("text"))
    both = touched.hint("merge").join(gone, touched["doc_id"].eqNullSafe(gone["of"]) & (touched["digest"] == gone["as"]), "left")
    lines = F.split("text", "\n", -1)

    def kept(cut: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n")

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(lines), kept), F.lit(0)))
    n_deleted = F.coalesce(F.size(F.when(F.col("gone").isNotNull(), F.col("gone"))), F.lit(0)).cast("long")
    return untouched.union(both.select("row", text.alias("kept"), n_lines, n_deleted.alias("n_deleted")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the runs of lines that stand earlier in the corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("row.doc_id", F.col("kept").alias("text"), "n_lines", "n_deleted")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns; text, and n_chars where there is one, are those of what is left."""
    out = without_repeats(docs)
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = f"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where text is not null
), t as (
  select *, trim(regexp_replace(x, '[\\t\\r\\x0B\\f]+', ' ', 'g')) as s from l
), k as (
  select *, len(string_split_regex(s, ' +')) as n, lead(s) over w as s2, lead(s, 2) over w as s3, lead(i) over w as i2, lead(i, 2) over w as i3 from t where s <> '' window w as (partition by doc_id order by i)
), places as (
  select doc_id, i as line, 'run:' || s || chr(10) || s2 || chr(10) || s3 as key, [i, i2, i3] as lines from k where s3 is not null
  union all
  select doc_id, i, 'two:' || s || chr(10) || s2, [i, i2] from k where s2 is not null and n < {LONG_WORDS} and n + len(string_split_regex(s2, ' +')) >= {LONG_WORDS}
  union all
  select doc_id, i, 'line:' || s, [i] from k where n >= {LONG_WORDS}
), first as (
  select key, min((doc_id, line)) as place from places group by key having count(*) > 1
), gone as (
  select distinct doc_id, unnest(lines) as i from places join first using (key) where (doc_id, line) > place
), kept as (
  select l.doc_id, string_agg(x, chr(10) order by l.i) filter (where gone.i is null) as text, count(*) as n_lines, count(gone.i) as n_deleted
  from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i group by l.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted
from documents d left join kept k using (doc_id)
"""
