"""Near-duplicate vectors by an exact metric range join within labels.

Vectors of one label link when their cosine is at least a threshold, that is, when their
unit vectors are at most r = sqrt(2 - 2 threshold) apart.

1. Equal vectors of a label fall into one class, which the smallest vec_id stands for.
2. Pivots (vectors of the table, a bounded number) cut each label into cells: a class is
   at home with its nearest pivot h. How many there are is chosen by the copies that they
   cost a bounded sample and by the size of the largest label: few for small tables and
   for vectors that lie in no clusters, many for large ones. Only cost depends on it. It is also copied to cell c if it may be within r of a
   vector at home there. By the triangle inequality that needs
   d(c) - d(h) <= 2 r; the distance to the plane midway between the two pivots also
   changes by at most r, which needs d(c)^2 - d(h)^2 <= 2 r |c - h|. Both must hold.
3. Cells join independently. Each class finds all its partners in its home cell, so its
   links are counted there, and only sums and one spanning link a class leave the cell,
   never all pairs of a group. A cell of more than ``BLOCK`` classes is cut into blocks,
   each pair of blocks a task of its own.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components,
and those without a label, link with nothing and are their own components; vectors of
different lengths don't link; a vec_id on several rows is one vector (of the usable ones
the one that sorts first) and has a result on each; a null vec_id keeps its row, with 0
links and a null component; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm.shared import components, dropped, spread_join, written

THRESHOLD, BLOCK = 0.98, 4096
#: Numbers of pivots to choose from, and the classes that are looked at for that.
PIVOTS, SAMPLE = (8, 32, 128, 512, 2048), 1024
#: What is added to distances, whose square roots lose half of a double's digits near 0.
SLACK = 1e-6


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cells_of(u: np.ndarray, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors, the nearest pivot and which cells each may have a partner in."""
    square = np.maximum(2 - 2 * (u @ p.T), 0)
    home = square.argmin(axis=1)
    own = square[np.arange(len(u)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[home]
    copied = (np.sqrt(square) - np.sqrt(own) <= 2 * r) & (square - own <= 2 * r * apart + SLACK)
    copied[np.arange(len(u)), home] = True
    return home, copied


def chosen_pivots(sample: np.ndarray, rows: int, r: float, numbers=PIVOTS) -> np.ndarray:
    """The first vectors of a sample of unit vectors, as many as cost least for a label of ``rows`` classes.

    A class is copied so often, and each copy is compared with the classes at home in a cell.
    """
    best, least = sample[:1], np.inf
    for n in numbers:
        pivots = sample[:n]
        copies = cells_of(sample[-SAMPLE:], pivots, r)[1].sum(axis=1).mean()
        cost = copies * (1 + rows / len(pivots) / BLOCK)
        if cost < least:
            best, least = pivots, cost
        if n >= len(sample):
            break
    return best


def dealt(classes: DataFrame, threshold: float, numbers=PIVOTS) -> DataFrame:
    """(label, dim, cell, home, rep, m, embedding): each class in its home cell and where it is copied to."""
    spark = classes.sparkSession
    picked = classes.orderBy(F.xxhash64("rep"), "rep").limit(max(numbers) + SAMPLE).select("dim", "embedding").collect()
    rows = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("rows"))
    by_dim: dict[int, list] = {}
    for x in picked:
        by_dim.setdefault(x["dim"], []).append(x["embedding"])
    r = float(np.sqrt(2 - 2 * threshold)) + SLACK
    unit = {d: _unit(np.array(x, np.float64)) for d, x in by_dim.items()}
    # of the dimensions only those of picked vectors, which are few
    largest = {x["dim"]: x["rows"] for x in rows.where(F.col("dim").isin(*unit)).collect()} if unit else {}
    shared = spark.sparkContext.broadcast({d: np.unique(chosen_pivots(u, largest[d], r, numbers), axis=0) for d, u in unit.items()})
    kind = {f.name: f.dataType.simpleString() for f in classes.schema}

    def task(batches):
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                u = _unit(_matrix(batch.column("embedding").take(pa.array(at))))
                p = shared.value.get(dim)
                if p is None:
                    out.append((at, np.zeros(len(at), np.int64), np.ones(len(at), bool)))
                    continue
                home, copied = cells_of(u, p, r)
                row, cell = np.nonzero(copied)
                out.append((at[row], cell, home[row] == cell))
            rows, cells, homes = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("label", "dim")), pa.array(cells.astype(np.int32)), pa.array(homes), *(batch.column(c).take(pa.array(rows)) for c in ("rep", "m", "embedding"))], ["label", "dim", "cell", "home", "rep", "m", "embedding"])

    return classes.select("label", "dim", "rep", "m", "embedding").mapInArrow(task, f"label {kind['label']}, dim int, cell int, home boolean, rep long, m long, embedding {kind['embedding']}")


def join_cell(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """(rep, links, low) of the classes at home in a block: vectors linked with other classes, and the smallest class their links reach here."""
    ids, other = left.column("rep").to_numpy(), right.column("rep").to_numpy()
    links, low = np.zeros(len(ids), np.int64), ids.copy()
    reach = other.copy()
    near = np.zeros((len(ids), len(other)), bool)
    if len(ids) and len(other):
        m = right.column("m").to_numpy()
        x, y = _matrix(left.column("embedding")), _matrix(right.column("embedding"))
        nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        near = ((x @ y.T) / nx[:, None] / ny >= threshold) & (ids[:, None] != other)
        links = near @ m
        before = -1
        while before != (total := int(low.sum() + reach.sum())):  # least ids spread along links until they rest
            before = total
            low = np.minimum(low, np.where(near, reach, np.iinfo(np.int64).max).min(axis=1))
            reach = np.minimum(reach, np.where(near, low[:, None], np.iinfo(np.int64).max).min(axis=0))
    linked = near.any(axis=0)
    return pa.table({"rep": pa.array(np.concatenate([ids, other[linked]])), "links": pa.array(np.concatenate([links, np.zeros(linked.sum(), np.int64)])), "low": pa.array(np.concatenate([low, reach[linked]]))})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, numbers: tuple[int, ...] | None = None) -> DataFrame:
    """vec_id, n_links, component_id of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    one = vectors.where(usable).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    # a class is known by a digest, so that vectors are shuffled no more than once
    one = written(spark, one.withColumn("same", F.sha2(F.to_json(F.struct("label", "embedding")), 256)), "vectors")
    classes = one.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    classes = written(spark, classes.withColumn("dim", F.size("embedding")), "classes")
    cells = written(spark, dealt(classes, threshold, PIVOTS if numbers is None else numbers), "cells")
    again = spark.read.schema(cells.schema).parquet(cells._wordmill_path)  # a cogroup's sides need columns of their own
    key = ["label", "dim", "cell"]
    blocks = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("in_cell")).withColumn("g", F.ceil(F.col("in_cell") / BLOCK).cast("int"))
    blocks = written(spark, blocks, "blocks", packed=True)
    spot = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    every = lambda: F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    names = [*key, "i", "j", "rep", "m", "embedding"]
    left = spread_join(cells.where("home"), blocks, key, "in_cell").withColumn("i", spot).withColumn("j", every()).select(names)
    right = spread_join(again, blocks, key, "in_cell").withColumn("i", every()).withColumn("j", spot).select(names)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        return join_cell(left, right, threshold)

    tiles = [*key, "i", "j"]
    found = written(spark, left.groupBy(*tiles).cogroup(right.groupBy(*tiles)).applyInArrow(task, "rep long, links long, low long"), "near")
    dropped(spark, cells, blocks)
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(spark, found.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    per_class = classes.select("same", "rep", "m").join(sums, "rep", "left").join(group.withColumnRenamed("id", "rep"), "rep", "left").select(
        "same", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    per_class = written(spark, per_class, "linked")
    linked = spread_join(one.select("vec_id", "same"), per_class, ["same"], "m").select(F.col("vec_id").alias("id"), F.col("links").cast("long").alias("n_links"), "component_id")
    return vectors.select("vec_id").join(linked, F.col("vec_id") == F.col("id"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links and component, and whether it is kept."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = f"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x))) and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v as a join v as b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach(a, c) as (
  select vec_id, vec_id from embeddings union select l.a, r.c from reach r join links l on l.b = r.a
), n as (select a, count(*) as n_links from links group by a), c as (select a, min(c) as component_id from reach group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings e left join n on n.a = vec_id left join c on c.a = vec_id
"""
