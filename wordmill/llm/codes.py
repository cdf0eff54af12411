"""Vector code compression by delta-maintained Lloyd rounds.

A vector is cut into equal parts; a part's code is the number of the nearest entry in the
codebook of its place. Codebooks are improved in rounds: every part is assigned to its
nearest entry, then each entry becomes the floor of the mean of its parts.

The table of vectors carries the assignment of the round before, and sums and counts of
all entries are kept in whole numbers. A round writes the new assignment beside the old
one; only vectors with a part whose code changed are read again, and of these only the
changed parts count: plus where the part is now, minus where it was. A task adds these up
before the shuffle, which moves at most one number for each component of each entry and
task, and the driver gets as many as the codebooks have. The rounds end early when nothing
changed. Whole numbers make the running sums equal to sums made anew (tested).

Defined cases: vectors that are null or hold null or non-finite components are dropped;
rows of equal vec_id count one by one; a null vec_id keeps its row and comes last; vectors
of each number of components have codebooks of their own, with parts that differ by one
component where the number can't be divided (an empty vector has empty parts, code 0 and
no error), and more than ``LENGTHS`` different numbers are an error; with fewer vectors
than entries there are as many entries as vectors; equal labels, also null ones, share
label_error; a component beyond 2^40 after scaling, or a sum of squared distances beyond 64
bits in the result, is an error; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.llm import blocks
from wordmill.llm.shared import dropped, modest, spread_join, written
from wordmill.llm.vectors import comfortable, floors, matrix, means, squared, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Different numbers of components that a table may have, since each has its own codebooks.
LENGTHS = 64
#: The code of a part that has none yet.
NONE = 255

Books = dict[int, list[np.ndarray]]  # by the number of components, for each part its entries


def spans(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each number of components."""
    sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        yield dim, np.flatnonzero(sizes == dim)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def assigned(table: DataFrame, books: Books, parts: int, final: bool = False) -> DataFrame:
    """``table`` (vec_id, label, x, code) with its codes as ``before``, new codes and, if ``final``, the squared distances of all parts together."""

    @blocks.trimmed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros((batch.num_rows, parts), np.uint8)
            error = np.zeros(batch.num_rows, object) if final else np.full(batch.num_rows, None)
            for dim, rows in _by_length(batch):
                grid = matrix(batch.column("x").take(pa.array(rows))).reshape(len(rows), dim)
                for p, (b, e) in enumerate(spans(dim, parts)):
                    x, c = comfortable(grid[:, b:e], books[dim][p])
                    away = squared(x, c)
                    code[rows, p] = away.argmin(axis=1)
                    if final:
                        error[rows] += np.array([int(d) for d in away.min(axis=1)], object)
            columns = [*(batch.column(c) for c in ("vec_id", "label", "x", "code")), pa.array([bytes(c) for c in code], pa.binary()), pa.array(error.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "before", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in table.schema}
    return table.select("vec_id", "label", "x", "code").mapInArrow(task, f"vec_id {kind['vec_id']}, label {kind['label']}, x array<long>, before binary, code binary, error long")


def deltas(table: DataFrame, entries: int, parts: int) -> DataFrame:
    """dim, part, entry, place, value: what the parts whose code changed add to the sums of components and, at place -1, to the counts."""

    @blocks.trimmed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            old, new = _codes(batch.column("before"), parts), _codes(batch.column("code"), parts)
            for dim, rows in _by_length(batch):
                grid = matrix(batch.column("x").take(pa.array(rows))).reshape(len(rows), dim)
                for p, (b, e) in enumerate(spans(dim, parts)):
                    was, now = old[rows, p], new[rows, p]
                    own = sums.setdefault((dim, p), np.zeros((entries, 1 + e - b), np.int64))
                    worth = np.concatenate([np.ones((len(rows), 1), np.int64), grid[:, b:e]], axis=1)
                    moved = was != now
                    np.add.at(own, now[moved], worth[moved])
                    moved &= was != NONE
                    np.add.at(own, was[moved], -worth[moved])
        out = [(dim, p, int(k), int(i) - 1, int(own[k, i])) for (dim, p), own in sums.items() for k, i in zip(*np.nonzero(own))]
        columns = zip(*out) if out else [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "part", "entry", "place", "value"])

    changed = table.where("before <> code").select("x", "before", "code")
    found = changed.mapInArrow(task, "dim int, part int, entry int, place int, value long")
    return found.groupBy("dim", "part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def first_books(kept: DataFrame, entries: int, parts: int) -> Books:
    """The parts of the vectors with the smallest ids, for each number of components; few rows reach the driver."""
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "x")
    sized = kept.withColumn("dim", F.size("x"))
    if len(lengths := sized.select("dim").distinct().limit(LENGTHS + 1).collect()) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} different numbers of components, {sorted(r['dim'] for r in lengths)[:5]} among them")
    # a limit by rank is taken in every task before the shuffle
    rows = sized.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= entries).select("dim", "rank", "x").collect()
    books: Books = {}
    for dim in sorted({r["dim"] for r in rows}):
        own = [r["x"] for r in sorted(rows, key=lambda r: r["rank"]) if r["dim"] == dim]
        grid = np.array(own, np.int64).reshape(len(own), dim)
        books[dim] = [grid[:, b:e] for b, e in spans(dim, parts)]
    return books


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for entry in part.tolist() for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """vec_id, label, dim, code, error of every usable row of ``vectors`` (vec_id, embedding, label), and the codebooks."""
    if not 0 < entries <= NONE:
        raise ValueError(f"a codebook has 1 to {NONE} entries")
    spark = vectors.sparkSession
    modest(spark)
    none = F.lit(bytearray([NONE] * parts))
    kept = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", floors(F.col("embedding"), scale).alias("x"), none.alias("code"))
    table = written(spark, kept, "codes")
    books = first_books(table, entries, parts)
    sums: dict[tuple, int] = {}
    for _ in range(rounds):
        before, table = table, written(spark, assigned(table, books, parts), "codes")
        dropped(spark, before)
        moved = deltas(table, entries, parts).collect()  # as many numbers as the codebooks have, at most
        if not moved:
            break
        for r in moved:
            key = r["dim"], r["part"], r["entry"], r["place"]
            sums[key] = sums.get(key, 0) + int(r["value"])
        for dim, book in books.items():
            for p, part in enumerate(book):
                means_of = [means([sums.get((dim, p, k, i), 0) for i in range(part.shape[1])], sums.get((dim, p, k, -1), 0), e) for k, e in enumerate(part.tolist())]
                book[p] = np.array(means_of, np.int64).reshape(part.shape)
    final = assigned(table, books, parts, final=True).select("vec_id", "label", F.size("x").alias("dim"), F.lower(F.hex("code")).alias("code"), "error")
    out = written(spark, final, "codes")
    dropped(spark, table)
    return out, books


def decoded(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector that its code stands for."""
    book = F.create_map(*[x for dim, parts in books.items() for x in (F.lit(dim), F.array(*[F.array(*[F.array(*[F.lit(v / scale) for v in e]) for e in part.tolist()]) for part in parts]))])
    number = lambda p: F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return codes.select("vec_id", F.flatten(F.transform(F.element_at(book, F.col("dim")), lambda part, p: F.get(part, number(p)))).alias("embedding"))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors of equal labels together; a label may have any share of the rows."""
    keyed = codes.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = written(codes.sparkSession, keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "labels", packed=True)
    return spread_join(keyed, sums, ["_label"], "_n").drop("_label", "_n")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and its error, that of its label, and the digest of the codebooks."""
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    told = F.lit(None).cast("string")
    for dim, book in books.items():
        told = F.when(F.col("dim") == dim, digest(book)).otherwise(told)
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", told.alias("codebooks_sha256"))


_FLOOR = "cast((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) as bigint)"


def _oracle() -> str:
    """Lloyd's rounds over (vector, part, component) rows, for vectors of one length that can be divided."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""
d{n} as (select v.r, v.p, c.k, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{n} c using (p, i) group by v.r, v.p, c.k),
a{n} as materialized (select r, p, k, d from d{n} qualify row_number() over (partition by r, p order by d, k) = 1)""")
        if n < ROUNDS:
            steps.append(f"""
c{n + 1} as materialized (
  select c.p, c.k, c.i, coalesce(m.x, c.x) as x
  from c{n} c left join (select a.p, a.k, v.i, {_FLOOR} as x from v join a{n} a using (r, p) group by a.p, a.k, v.i) m using (p, k, i))""")
    return f"""
with kept as materialized (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as x
  from embeddings where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))),
flat as (select r, len(x) // {PARTS} as w, unnest(range(len(x))) as j, unnest(x) as x from kept),
v as materialized (select r, j // w as p, j % w as i, x from flat),
first as (select r, row_number() over (order by vec_id nulls last, x) - 1 as k from kept),
c0 as materialized (select p, k, i, x from v join first using (r) where k < {ENTRIES}),{",".join(steps)},
coded as (select r, string_agg(printf('%02x', k), '' order by p) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by p, k, i)) from c{ROUNDS}) as codebooks_sha256
from coded join kept using (r)
"""


ORACLE = _oracle()
