"""Tables in the folder that driver and executors share, and what several operators need."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that goes to Python.
ARROW_BYTES = 8 << 20

_own: list[str] = []
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, as in tests on one machine, one of our own.

    On a cluster an unset folder is an error: executors share no local one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="wordmill-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def written(spark: SparkSession, df: DataFrame, name: str, packed: bool = False, options: dict | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs a read.

    ``packed`` is for tables much smaller than what their tasks read: a shuffle of the few
    rows puts them into files of a fair size, instead of a small one for every task.
    """
    folder = f"{shared_dir(spark)}/wordmill-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_deleted, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    rows = df.hint("rebalance") if packed else df
    rows.write.options(**(options or {})).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._wordmill_path = path
    return table


def _deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder; at the end of the application, whatever tables were left, if the JVM still answers."""
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except (Py4JError, OSError):
        pass


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more; others go when the application ends."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._wordmill_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def modest(spark: SparkSession) -> None:
    """Lets batches that go to Python hold at most ``ARROW_BYTES``, for this session, where nobody set another bound.

    Both the executor's JVM and the worker hold a batch as a whole, beside the heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(key, ARROW_BYTES)


class Bitmap:
    """A set of hashed keys in a fixed number of bits: what is in the set is always in it, and perhaps more is."""

    def __init__(self, bits: int, words: dict[int, bytes]):
        self.bits, self.words = bits, words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each 64-bit hash may be in the set."""
        if not hasattr(self, "_flat"):
            flat = np.zeros(self.bits // 8, np.uint8)
            for bucket, part in self.words.items():
                flat[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(part)] = np.frombuffer(part, np.uint8)
            self._flat = flat
        slot = (hashes & np.uint64(self.bits - 1)).astype(np.int64)
        return (self._flat[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    def __getstate__(self):
        return {"bits": self.bits, "words": self.words}


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits)) + 1


def bitmap_of(hashes: DataFrame, bits: int) -> Bitmap:
    """The only column's 64-bit hashes as a bitmap. At most ``bits`` / 8 bytes reach the driver."""
    slot = _slot(F.col(hashes.columns[0]), bits)
    rows = hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    return Bitmap(bits, {r["bucket"]: bytes(r["bits"]) for r in rows.collect()})


def maybe_in(table: DataFrame, key: Column, marked: Bitmap, inside: bool) -> DataFrame:
    """Rows whose key may be in a bitmap of xxhash64 of keys, or those whose key surely isn't."""
    spark = table.sparkSession
    slot = _slot(F.xxhash64(key), marked.bits)
    words = spark.createDataFrame([(b, bytearray(x)) for b, x in marked.words.items()], "_bucket long, _bits binary")
    told = table.withColumn("_at", slot).join(F.broadcast(words), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left")  # bits of a fixed number
    position = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.call_function("getbit", byte, (position % 8).cast("int")) == 1, F.lit(False))
    return told.where(on if inside else ~on).select(*[f"`{c}`" for c in table.columns])


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str = "n", most: int = 1024) -> DataFrame:
    """Inner join of many rows with one row a key, whatever share of the rows a key has.

    ``right`` has a row for each key with the number of the key's rows in ``left``. The
    ``most`` keys with the largest numbers are broadcast, a bounded number of rows; each
    other key has less than 1 / ``most`` of all rows, so the shuffle is even. Both sides
    should be written tables, since they are read twice.
    """
    hot = right.orderBy(F.desc(count), *keys).limit(most)
    rest = left.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.hint("merge").join(right, keys))


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component_id): the smallest id reachable by links(a, b), for every id that has a link.

    Alternates two steps until nothing changes: each id is tied to the smallest of its
    larger-id neighbours' side (large star), then smaller neighbours are tied together
    (small star). Both are a combinable minimum by id and a join with one row for each id,
    never a list of neighbours. The ids with the most links are joined by broadcast, a
    bounded number of them, so that no task gets all links of one id. Each round is
    written to the shared folder.
    """
    edges = written(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        before = edges
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        low = edges.select(F.col("u").alias("c"), F.col("v").alias("m"), F.lit(0).alias("k")).union(edges.select("v", "v", F.lit(1)))
        low = written(spark, low.groupBy("c").agg(F.min("m").alias("m"), F.sum("k").alias("k")).where("k > 0"), "low", packed=True)
        both = edges.select(F.col("v").alias("c"), F.col("u").alias("n"))  # n > c
        star = spread_join(both, low, ["c"], "k").select(F.col("n").alias("u"), F.col("m").alias("v")).distinct()
        star = written(spark, star, "links")
        dropped(spark, low)
        # small star: the smaller neighbours of u, and u, are tied to the smallest of them
        low = written(spark, star.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), "low", packed=True)
        rest = spread_join(star, low.where("k > 1"), ["u"], "k").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(spark, rest.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        # no row joins as a child and as a parent when every component is a star
        open_ends = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        split = edges.groupBy("u").count().where("count > 1").limit(1).count()
        dropped(spark, before, star, low)
        released(spark)
        if not open_ends and not split:
            break
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select("v", "v").distinct())
