"""Coverage of a stream of texts, in windows of event time: an extension, every step a stream-static join or projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.functions import text as T
from wordmill.sources.lexicon import for_join


def windowed(stream: DataFrame, forms: DataFrame, time: str, text: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, total, known for each window; works on a stream and on a table alike."""
    known = forms.select(F.col("form").alias("folded")).distinct().withColumn("hit", F.lit(1))
    kept = T.tokens(stream.withWatermark(time, late) if stream.isStreaming else stream, text, least=1, keep=(time,))
    found = kept.withColumn("folded", F.lower("token")).join(for_join(known), "folded", "left")
    return found.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("known")).select(F.col("w.start").alias("start"), "total", "known")
