"""Exact top-k search by aggregation without random access.

A query's score of a vector is the inner product of their integer components. Vectors
are sorted by each component; a query reads each list from the end that helps its score
(the top for its positive components, the bottom for its negative ones), in steps of
growing depth. What has been read so far gives each vector a lower bound (unread entries
are as bad as the list's other end) and an upper bound (they are no better than the last
entry read). After a step, vectors whose upper bound is below the k-th lower bound leave.
A query stops when few are left, so that no outsider can qualify, and reads the rest of
its lists only for these to resolve their final scores; where bounds never close it has
read all lists in the end, and its scores are the sums of what it read.

The first ``PILOT`` queries of a block test their bounds after every step. The others
test them from the least depth at which one of these closed; until there they only read.

Queries and vectors are dealt into blocks by a hash, and every block of queries meets
every block of vectors in a task of its own, in arrays of a fixed size. Each block gives
at most k rows a query; the k best of these are the result. Sums are exact: in doubles
where no sum can reach 2^53, else in whole numbers of any length.

Defined cases: vectors that are null or hold null or non-finite components take no part;
a query only meets vectors with as many components; a vec_id on several rows counts once,
with the array that sorts first; a null vec_id takes no part; queries with fewer than k
others have fewer rows; ties go to the smaller vec_id; a score beyond 64 bits is an
error; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of queries that meet in a task; rows of the arrays compared at once.
VECTORS, QUERIES, ROWS, AT_ONCE = 1 << 16, 1 << 14, 4096, 512
#: Parts of the lists after which bounds are tested, and the queries that try them all.
DEPTHS, PILOT = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 1.0), 16


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>, dim): floor(scale * component) of every usable vector, once for each vec_id."""
    # floats beyond any bigint can't be scaled; they are finite, and far beyond any embedding
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    return usable.select("vec_id", whole.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))


class Lists:
    """The sorted lists of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.m = ids, len(x)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.place = np.empty(x.shape, np.int64)  # how far from the bottom a vector stands in each list
        np.put_along_axis(self.place, self.order, np.arange(self.m)[:, None], axis=0)

    def entries(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """What the next entries, from depth ``low`` to ``high``, say of each vector: by the lists' tops and by their bottoms."""
        tops, bottoms = np.zeros(self.place.shape), np.zeros(self.place.shape)
        np.put_along_axis(tops, self.order[self.m - high : self.m - low], self.values[self.m - high : self.m - low], axis=0)
        np.put_along_axis(bottoms, self.order[low:high], self.values[low:high], axis=0)
        return tops, bottoms


def aggregate(lists: Lists, q_ids: np.ndarray, q: np.ndarray, k: int, depths=DEPTHS) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(query, vector, score) of each query's k best in a block, ties to the smaller id; and the depth at which each query stopped."""
    m = lists.m
    plus, minus = np.maximum(q, 0.0), np.minimum(q, 0.0)
    seen = np.zeros((len(q), m))
    left = q_ids[:, None] != lists.ids[None, :]
    open_, stopped = np.arange(len(q)), np.full(len(q), m)
    read = 0
    for depth in sorted({min(m, max(1, int(m * part))) for part in (*depths, 1.0)}):
        tops, bottoms = lists.entries(read, depth)
        seen[open_] += plus[open_] @ tops.T + minus[open_] @ bottoms.T
        read = depth
        if read == m or read <= k:
            continue
        p, n = plus[open_], minus[open_]
        unread_top, unread_bottom = lists.place < m - read, lists.place >= read
        bound = lambda top, bottom: seen[open_] + p @ (unread_top * top).T + n @ (unread_bottom * bottom).T  # noqa: B023, E731
        lower = np.where(left[open_], bound(lists.values[0], lists.values[m - 1]), -np.inf)
        kth = np.partition(lower, m - k, axis=1)[:, m - k]
        left[open_] &= bound(lists.values[m - read], lists.values[read - 1]) >= kth[:, None]
        done = left[open_].sum(axis=1) <= 2 * k
        for i in open_[done].tolist():
            stopped[i] = read
            _resolve(lists, seen[i], q[i], np.flatnonzero(left[i]), read)
        open_ = open_[~done]
        if not len(open_):
            break
    out = []
    for i, qid in enumerate(q_ids.tolist()):
        at = np.flatnonzero(left[i])
        scores = seen[i, at]
        if len(at) > k:
            at = at[scores >= np.partition(scores, len(at) - k)[len(at) - k]]
        at = at[np.lexsort((lists.ids[at], -seen[i, at]))][:k]
        out += [(qid, int(lists.ids[j]), int(seen[i, j])) for j in at.tolist()]
    return out, stopped


def _resolve(lists: Lists, seen: np.ndarray, q: np.ndarray, wanted: np.ndarray, read: int) -> None:
    """Adds what the rest of a query's lists say of the wanted vectors, reading on from where it stopped."""
    is_wanted = np.zeros(lists.m, bool)
    is_wanted[wanted] = True
    for c in np.flatnonzero(q).tolist():
        rest = slice(0, lists.m - read) if q[c] > 0 else slice(read, lists.m)
        ids = lists.order[rest, c]
        met = is_wanted[ids]
        seen[ids[met]] += q[c] * lists.values[rest, c][met]


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best among the vectors; q and x are whole numbers."""
    reach = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * x.shape[1]
    if reach >= 1 << 52:
        return _long(q_ids, q, ids, x, k)
    found: list[tuple[int, int, int]] = []
    for at in range(0, len(x), ROWS):
        lists = Lists(ids[at : at + ROWS], x[at : at + ROWS].astype(np.float64))
        first, stopped = aggregate(lists, q_ids[:PILOT], q[:PILOT].astype(np.float64), k)
        depths = [p for p in DEPTHS if p * lists.m >= stopped.min(initial=lists.m)]
        found += first
        for b in range(PILOT, len(q), AT_ONCE):
            found += aggregate(lists, q_ids[b : b + AT_ONCE], q[b : b + AT_ONCE].astype(np.float64), k, depths)[0]
    best: dict[int, list[tuple[int, int]]] = {}
    for qid, vec, score in found:
        best.setdefault(qid, []).append((-score, vec))
    return [(qid, vec, -minus) for qid, rows in best.items() for minus, vec in sorted(rows)[:k]]


def _long(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``search`` in whole numbers of any length, for components that no embedding has: every list is read to its end."""
    out = []
    rows = [[int(v) for v in r] for r in x]
    for qid, own in zip(q_ids.tolist(), q):
        own = [int(v) for v in own]
        scores = sorted((-sum(a * b for a, b in zip(own, r)), i) for r, i in zip(rows, ids.tolist()) if i != qid)[:k]
        if any(abs(s) >= 1 << 63 for s, _ in scores):
            raise OverflowError(f"a score of query {qid} does not fit into 64 bits")
        out += [(qid, i, -s) for s, i in scores]
    return out


def top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query (vec_id, x, dim) against all vectors but its own."""
    most = vectors.sparkSession.sparkContext.defaultParallelism
    counts = vectors.agg(F.count(F.lit(1))).first()[0], queries.agg(F.count(F.lit(1))).first()[0]
    # large blocks, since each is copied to all of the other side; smaller ones only while cores would idle
    nv, nq = max(1, -(-counts[0] // VECTORS), min(most, -(-counts[0] // ROWS))), max(1, -(-counts[1] // QUERIES))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = ["dim", "qb", "vb", "vec_id", "x"]
    left = queries.withColumn("qb", part(nq)).withColumn("vb", every(nv)).select(names).toDF("dim", "qb", "vb", "query_id", "q")
    right = vectors.withColumn("vb", part(nv)).withColumn("qb", every(nq)).select(names)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            grid = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            rows = search(left.column("query_id").to_numpy(), grid(left, "q"), right.column("vec_id").to_numpy(), grid(right, "x"), k)
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    key = ["dim", "qb", "vb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest scores of each vector whose id is divisible by 50."""
    vectors = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top(vectors.where("vec_id % 50 = 0"), vectors, 5)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))
), s as (
  select q.vec_id as query_id, v.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) as bigint) as score
  from v as q join v on q.vec_id <> v.vec_id and len(q.x) = len(v.x)
  where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
