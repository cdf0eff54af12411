"""A lexicon of any size as saved tables: word forms in buckets, and a filter of what they hold.

``store`` writes the forms in buckets by form, as many as a shuffle has partitions, sorted.
A table of tokens that is grouped by token meets them without another exchange, and the
forms are never shuffled or broadcast again. Beside it stands a Bloom filter of the forms:
two bits for each, sixteen places a form, in pages of 4 KB. It goes to every executor if
it has at most ``MOST_BITS`` bits (32 MB, some 16 million forms), and words that are surely
unknown leave before the join. Tokens are counted first, so that the filter is asked once
for each distinct word, not for each token; what is shuffled are the tasks' own counts.
"""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions import text as T

#: Places of the filter for each form, and the most bits that are sent to every executor.
PLACES, MOST_BITS = 16, 1 << 28
#: Bytes of a page of ``bitmap_construct_agg``.
PAGE = 4096


def _slots(form: Column, bits: int) -> tuple[Column, Column]:
    """Two places of a form, from independent hashes, counted from 1."""
    return F.pmod(F.xxhash64(form), F.lit(bits)) + 1, F.pmod(F.xxhash64(form, F.lit("again")), F.lit(bits)) + 1


class Stored:
    """A saved lexicon."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        about = spark.table(f"{name}_about").first()
        self.rows, self.bits, self.buckets = about["n_forms"], about["bits"], about["buckets"]

    @property
    def forms(self) -> DataFrame:
        return self.spark.table(self.name)

    def maybe_known(self, tokens: DataFrame, column: str = "folded") -> DataFrame:
        """Tokens without those that the filter is sure of; all of them where the filter is too large to send."""
        if self.bits > MOST_BITS:
            return tokens
        pages = self.spark.table(f"{self.name}_filter")
        out = tokens
        for i, slot in enumerate(_slots(F.col(column), self.bits)):
            page = pages.select(F.col("page").alias(f"_page{i}"), F.col("word").alias(f"_word{i}"))
            at = F.bitmap_bit_position(slot)
            # the pages hold MOST_BITS / 8 bytes at most
            out = out.join(F.broadcast(page), F.bitmap_bucket_number(slot) == F.col(f"_page{i}"))
            byte = F.conv(F.hex(F.substring(f"_word{i}", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out.where(F.call_function("getbit", byte, (at % 8).cast("int")) == 1).drop(f"_page{i}", f"_word{i}")
        return out

    def counted(self, tokens: DataFrame, n: str | None = None) -> DataFrame:
        """folded, n of tokens(token) that may be known: grouped by what the forms are bucketed by, then filtered.

        A column ``n`` has how often a token stands, where tokens are counted already.
        """
        times = F.lit(1).cast("long") if n is None else F.col(n)
        own = tokens.select(F.lower("token").alias("folded"), times.alias("n")).groupBy("folded")
        # the length is aggregated, so that no filter by it moves to the occurrences
        found = own.agg(F.sum("n").alias("n"), F.max(F.length("folded")).alias("size")).where(F.col("size") <= T.LONGEST)
        return self.maybe_known(found.drop("size"))

    def hits(self, tokens: DataFrame, n: str | None = None) -> DataFrame:
        """The columns of the forms, and n, of every known token: one exchange, that of the count."""
        return self.counted(tokens, n).hint("merge").join(self.forms, F.col("folded") == F.col("form"))

    def check_word(self, tokens: DataFrame, n: str | None = None) -> DataFrame:
        """folded, n of the known tokens."""
        return self.counted(tokens, n).hint("merge").join(self.forms, F.col("folded") == F.col("form"), "left_semi")

    def lemmatize(self, tokens: DataFrame, n: str | None = None) -> DataFrame:
        """folded, n, lexeme_id, lemma, pos, form_id: a row for each reading."""
        return self.hits(tokens, n).select("folded", "n", "lexeme_id", "lemma", "pos", "form_id").distinct()

    def drop(self) -> None:
        for table in (self.name, f"{self.name}_filter", f"{self.name}_about"):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def store(forms: DataFrame, name: str, buckets: int | None = None) -> Stored:
    """Saves word forms as the tables ``name``, ``name``_filter and ``name``_about in the session's warehouse."""
    spark = forms.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    forms.repartition(buckets, "form").write.bucketBy(buckets, "form").sortBy("form").mode("overwrite").saveAsTable(name)
    saved = spark.table(name)
    n = saved.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    bits = max(PAGE * 8, 1 << (n * PLACES - 1).bit_length()) if n else PAGE * 8
    one, two = _slots(F.col("form"), bits)
    slot = saved.select(F.explode(F.array(one, two)).alias("slot"))
    pages = slot.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("word"))
    pages.write.mode("overwrite").saveAsTable(f"{name}_filter")
    about = spark.createDataFrame([(n, bits, buckets)], "n_forms long, bits long, buckets int")
    about.write.mode("overwrite").saveAsTable(f"{name}_about")
    return Stored(spark, name)


_kept: dict[tuple[str, str], Stored] = {}


def once(spark: SparkSession, what: str, make) -> Stored:
    """The lexicon of ``make()``, saved once for an application under a name of its own and dropped at its end."""
    key = spark.sparkContext.applicationId, what
    if key not in _kept:
        _kept[key] = store(make(), f"wordmill_{uuid.uuid4().hex[:12]}")
        atexit.register(_dropped, _kept[key])
    return _kept[key]


def _dropped(stored: Stored) -> None:
    try:
        stored.drop()
    except (PySparkException, Py4JError, OSError):  # the session has ended before
        pass
