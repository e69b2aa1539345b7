"""Streaming loads, bars, de-duplication, tagging and boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tapeweave.operators.catalysts import actionable_catalysts, tag_keywords
from tapeweave.schemas import PRICE_COLUMNS
from tapeweave.sources.tables import Table


def event_time(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Watermarked frame. Watermarks need an instant, so wall-clock UTC times are cast."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def load_stream(source: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Upsert every micro-batch into a stored table.

    A batch that is replayed after a failure merges to the same rows, so each row lands once. The
    checkpoint remembers what was read. Runs until the available input is consumed.
    """
    return (
        source.writeStream.foreachBatch(lambda batch, _: table.upsert(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def bars_stream(ticks: DataFrame, length: str, delay: str = "10 minutes", order: str = "seq") -> DataFrame:
    """Closed bars from a tick stream, stamped with their end; ticks later than ``delay`` are dropped."""
    seen = event_time(ticks, delay)
    bars = seen.groupBy("symbol", F.window("ts", length)).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
    )
    return bars.select("symbol", F.col("window.end").alias("ts"), *PRICE_COLUMNS)


def dedup_stream(news: DataFrame, delay: str = "1 day") -> DataFrame:
    """News without repeats of (symbol, time, headline). The first copy stays, not the last."""
    return event_time(news, delay).dropDuplicatesWithinWatermark(["symbol", "ts", "headline"])


def catalyst_stream(news: DataFrame, **options) -> DataFrame:
    """Keyword catalysts of a news stream; needs no state."""
    return tag_keywords(news, **options)


def boost_stream(
    signals: DataFrame, catalysts: DataFrame, window_seconds: int = 86400, boost: float = 0.15,
    delay: str = "1 hour", salts: int = 8,
) -> DataFrame:
    """(symbol, ts, catalyst_boost) of a signal stream, each once its window can no longer change.

    A symbol's catalysts are spread over ``salts`` keys and its signals repeated to each, so that
    one symbol's state does not sit in one task; the largest boost over the salts is the answer.
    """
    weight = boost * F.col("strength") * F.col("confidence")
    left = event_time(signals.select("symbol", "ts"), delay, "ts").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    right = event_time(
        actionable_catalysts(catalysts).select(F.col("symbol").alias("c_symbol"), F.col("ts").alias("c_ts"), weight.alias("weight")),
        delay, "c_ts",
    ).withColumn("c_salt", F.pmod(F.xxhash64("c_ts", "weight"), F.lit(salts)).cast("int"))
    near = F.expr(f"c_ts BETWEEN ts - INTERVAL {window_seconds} SECONDS AND ts")
    joined = left.join(
        right, (F.col("symbol") == F.col("c_symbol")) & (F.col("salt") == F.col("c_salt")) & near, "leftOuter"
    )
    return joined.groupBy("symbol", "ts").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("catalyst_boost"))
