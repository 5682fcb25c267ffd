"""Pages that arrive as files, taken in by Structured Streaming with the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.functions.text import letter_tokens
from inkstone.operators.quality import route


def page_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def routed(pages: DataFrame) -> DataFrame:
    """Stateless: words of each page and its route, from the quality the page came with."""
    sized = pages.withColumn("n_words", F.size(letter_tokens(F.col("text"))))
    decision = route(F.col("n_words"), F.col("quality"), F.col("image_coverage"))
    return sized.select("doc", "page", "loaded_at", "n_words", decision["route"].alias("route"), decision["reason"].alias("reason"))


def arrivals(pages: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Pages by day of arrival and route; rows later than ``late`` after the newest are dropped by the watermark.

    A page that comes again within the watermark counts once.
    """
    once = pages.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["doc", "page"])
    return once.groupBy(F.window("loaded_at", window).alias("w"), "route").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words")).select(F.col("w.start").alias("day"), "route", "n", "n_words")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes in what is there and stops; the result is in the in-memory table ``name``."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
