"""Centroid clustering by filtering kd-trees.

1. The vectors of a task are cut into trees of at most ``TREE`` vectors. A node is halved
   along its widest component; it holds its count, its sum and its box in whole numbers.
   Trees are written once, with their vectors in tree order, and serve every round.
2. A round goes down each tree, level by level, with the centroids that may still be
   nearest to something in a node's box. A centroid is pruned if another one, the nearest
   to the box's middle, is strictly nearer to every point of the box; that needs a look at
   one corner only. A node with one centroid left is assigned as a whole, by its count and
   sum; leaves with several are resolved vector by vector.
3. A task gives one sum and one count for each centroid, so a round shuffles some
   thousand numbers for each task, and the driver gets as many as the centroids have.

Distances and sums are exact: in doubles where no product can need more than 53 bits, else
in whole numbers of any size. Equal distances go to the smaller number; since only
strictly dominated centroids are pruned, the trees change nothing in the result.

Defined cases: vectors that are null, have another number of components or hold null or
non-finite ones take no part; rows of equal vec_id count one by one; a null vec_id keeps
its row and comes last among the first centroids; of equal vectors at the start, the
later ones are empty centroids and stay; with fewer vectors than centroids there are as
many centroids as vectors; a component beyond 2^40 after scaling is an error; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import blocks
from wordmill.llm.shared import modest, written
from wordmill.llm.vectors import comfortable, floors, matrix, means, squared, usable

CENTROIDS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Vectors of a tree and of a leaf at most; bytes of a row group of trees, which is what a reader holds at once.
TREE, LEAF, GROUP = 4096, 32, 8 << 20
TREES = "kind string, x binary, low binary, high binary, sums binary"


def _cuts(n: int) -> list[np.ndarray]:
    """Where the nodes of each level of a tree of n vectors begin, and the end."""
    levels = [np.array([0, n])]
    while n > LEAF << (len(levels) - 1):
        b, e = levels[-1][:-1], levels[-1][1:]
        levels.append(np.append(np.stack([b, (b + e) // 2], axis=1).ravel(), n))
    return levels


class Tree:
    """Vectors in tree order, and the box and the sum of every node, level by level."""

    def __init__(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.x, self.cuts = x, _cuts(len(x))
        ends = np.cumsum([len(c) - 1 for c in self.cuts])
        self.levels = [(low[b:e], high[b:e], sums[b:e]) for b, e in zip([0, *ends[:-1].tolist()], ends.tolist())]

    @staticmethod
    def planted(x: np.ndarray) -> tuple[np.ndarray, Tree]:
        """The order of the vectors in a tree, and the tree."""
        order, cuts = np.arange(len(x)), _cuts(len(x))
        for above, level in zip(cuts, cuts[1:]):
            for b, m, e in zip(above[:-1].tolist(), level[1::2].tolist(), above[1:].tolist()):
                own = x[order[b:e]]
                widest = (own.max(axis=0) - own.min(axis=0)).argmax()
                order[b:e] = order[b:e][np.argpartition(own[:, widest], m - b, kind="introselect")]
        y = x[order]
        heads = [c[:-1] for c in cuts]
        nodes = [np.concatenate([f.reduceat(y, h, axis=0) for h in heads]) for f in (np.minimum, np.maximum, np.add)]
        return order, Tree(y, *nodes)

    def packed(self) -> list:
        """The columns of TREES."""
        kind = next(k for k in ("i1", "i2", "i4", "i8") if np.abs(self.x).max(initial=0) <= np.iinfo(k).max)
        low, high, sums = (np.concatenate([level[i] for level in self.levels]) for i in range(3))
        return [kind, *(a.astype(f"<{kind}").tobytes() for a in (self.x, low, high)), sums.astype("<i8").tobytes()]

    @staticmethod
    def unpacked(dim: int, kind: str, x: bytes, low: bytes, high: bytes, sums: bytes) -> Tree:
        grid = lambda b, k: np.frombuffer(b, f"<{k}").astype(np.int64).reshape(-1, dim)
        return Tree(grid(x, kind), grid(low, kind), grid(high, kind), grid(sums, "i8"))

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The centroid of every vector, and (level, node) of the nodes that were assigned as a whole."""
        home = np.full(len(self.x), -1)
        whole: list[tuple[int, int]] = []
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        for depth, (low, high, _) in enumerate(self.levels):
            a, b, c = comfortable(low[nodes], high[nodes], centroids)
            left = left & ~dominated(a, b, c, left)
            cuts, done = self.cuts[depth], left.sum(axis=1) == 1
            for node, z in zip(nodes[done].tolist(), left[done].argmax(axis=1).tolist()):
                home[cuts[node] : cuts[node + 1]] = z
                whole.append((depth, node))
            nodes, left = nodes[~done], left[~done]
            if depth + 1 < len(self.levels):
                nodes, left = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(left, 2, axis=0)
        cuts = self.cuts[-1]
        sizes = cuts[nodes + 1] - cuts[nodes]
        rows = np.repeat(cuts[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        x, c = comfortable(self.x[rows], centroids)
        home[rows] = np.where(np.repeat(left, sizes, axis=0), squared(x, c), np.inf).argmin(axis=1) if len(rows) else -1
        return home, whole

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count and the sum of every centroid's vectors: of whole nodes by what they hold."""
        home, whole = self.filtered(centroids)
        n, sums = np.bincount(home, minlength=len(centroids)), np.zeros(centroids.shape, np.int64)
        rest = np.ones(len(home), bool)
        for depth, node in whole:
            b, e = self.cuts[depth][node], self.cuts[depth][node + 1]
            sums[home[b]] += self.levels[depth][2][node]
            rest[b:e] = False
        np.add.at(sums, home[rest], self.x[rest])
        return n, sums


def dominated(low: np.ndarray, high: np.ndarray, c: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each box, the centroids that the one nearest to its middle is strictly nearer than to every point of the box."""
    middle = low + high
    near = (4 * (c * c).sum(axis=1)[None, :] - 4 * (middle @ c.T)).astype(np.float64)  # but for what all have in common
    best = np.where(left, near, np.inf).argmin(axis=1)
    out = np.zeros(left.shape, bool)
    for z in range(len(c)):
        apart = c[z] - c[best]
        corner = np.where(apart > 0, high, low)  # the point of the box that favours z most
        out[:, z] = (apart * (c[z] + c[best] - 2 * corner)).sum(axis=1) > 0
    return out


def _trees(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        yield batch.column("ids")[i].values, Tree.unpacked(dim, *(batch.column(c)[i].as_py() for c in ("kind", "x", "low", "high", "sums")))


def forest(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Every task's vectors (vec_id, x) as kd-trees, one in a row."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    @blocks.trimmed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            ids, x = table.column("vec_id").combine_chunks(), matrix(table.column("x").combine_chunks())
            order, tree = Tree.planted(x)
            own = ids.take(pa.array(order))
            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([lists, *(pa.array([v]) for v in tree.packed())], ["ids", "kind", "x", "low", "high", "sums"])

        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, TREE - n)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                n += part.num_rows
                if n == TREE:
                    yield made(waiting)
                    waiting, n = [], 0
        if n:
            yield made(waiting)

    return vectors.mapInArrow(task, f"ids array<{kind}>, {TREES}")


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; k rows reach the driver."""
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "x").orderBy(F.asc_nulls_last("mark"), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256 of every usable row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    modest(spark)
    kept = vectors.where(usable(F.col("embedding")) & (F.size("embedding") == dim)).select("vec_id", floors(F.col("embedding"), scale).alias("x"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(kept, k)
    columns = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], columns)
    trees = written(spark, forest(kept, dim, scale), "trees", options={"parquet.block.size": GROUP})

    def rounded(centroids: np.ndarray):
        @blocks.trimmed
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            for batch in batches:
                for _, tree in _trees(batch, dim):
                    more_n, more = tree.totals(centroids)
                    n, sums = n + more_n, sums + more
            at = np.flatnonzero(n)
            values = np.concatenate([n[at, None], sums[at]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(dim + 1, dtype=np.int32), len(at))), pa.array(values.ravel())], ["cluster", "place", "value"])

        return task

    for _ in range(rounds):
        found = trees.mapInArrow(rounded(centroids), "cluster int, place int, value long").groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        by = {(r["cluster"], r["place"]): int(r["value"]) for r in found.collect()}  # k * (dim + 1) at most
        centroids = np.array([means([by.get((z, i + 1), 0) for i in range(dim)], by.get((z, 0), 0), c) for z, c in enumerate(centroids.tolist())], np.int64)

    @blocks.trimmed
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, dim):
                home, _ = tree.filtered(centroids)
                x, c = comfortable(tree.x, centroids)
                away = x - c[home]
                distance = (away * away).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(home.astype(np.int32)), pa.array([int(d) for d in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    rows = written(spark, trees.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    told = [(z, inertia.get(z, 0), sum(inertia.values()), c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for z, c in enumerate(centroids.tolist())]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster and squared distance, and the sums over its cluster and over all."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).drop("centroid")


_FLOOR = "cast((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) as bigint)"


def _oracle() -> str:
    """Lloyd's rounds over (vector, component) rows."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""
d{n} as (select v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{n} c using (i) group by v.r, c.k),
a{n} as materialized (select r, k, d from d{n} qualify row_number() over (partition by r order by d, k) = 1)""")
        if n < ROUNDS:
            steps.append(f"""
c{n + 1} as materialized (
  select c.k, c.i, coalesce(m.x, c.x) as x
  from c{n} c left join (select a.k, v.i, {_FLOOR} as x from v join a{n} a using (r) group by a.k, v.i) m using (k, i))""")
    return f"""
with kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as x
  from embeddings where embedding is not null and len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM}),
v as materialized (select r, unnest(range({DIM})) as i, unnest(x) as x from kept),
first as (select *, row_number() over (order by sha256('1:' || vec_id) nulls last, x) - 1 as k from kept),
c0 as materialized (select k, unnest(range({DIM})) as i, unnest(x) as x from first where k < {CENTROIDS}),{",".join(steps)},
told as (select k, sha256(string_agg(cast(x as varchar), ',' order by i)) as sha from c{ROUNDS} group by k)
select vec_id, cast(k as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha as centroid_sha256
from a{ROUNDS} join kept using (r) join told using (k)
"""


ORACLE = _oracle()
