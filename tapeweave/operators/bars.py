"""Bars: aggregation to coarser timeframes, hole filling, close labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.timeframes import Timeframe, epoch_seconds
from tapeweave.schemas import PRICE_COLUMNS


def _binned(df: DataFrame, tf: Timeframe, keys: list[str]) -> DataFrame:
    """Add ``_bin``, the start of the row's bin."""
    if not tf.needs_origin:
        return df.withColumn("_bin", tf.bin_start(F.col("ts")))
    # Bins that count from the series start need one tiny extra aggregate per series.
    first = df.groupBy(*keys).agg(F.min("ts").alias("_first"))
    first = first.withColumn("_origin", tf.anchor(F.col("_first"))).drop("_first")
    return df.join(first, keys).withColumn("_bin", tf.bin_start(F.col("ts"), F.col("_origin"))).drop("_origin")


def resample_bars(
    df: DataFrame, timeframe: str, keys: list[str] = ["symbol"], order: str = "ts", label: str = "close"
) -> DataFrame:
    """Coarser bars from finer, start-labelled ones; empty bins do not appear.

    Rows come out stamped with the end of their bin (``label="close"``) or its start. ``order``
    names one column that orders rows inside a bin. Partial aggregates run before the shuffle.
    """
    tf = Timeframe(timeframe)
    present = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    bars = _binned(df, tf, keys).groupBy(*keys, "_bin").agg(
        F.min_by("open", present("open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", present("close")).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
    ).filter(F.col("close").isNotNull())
    stamp = tf.bin_end(F.col("_bin")) if label == "close" else F.col("_bin")
    return bars.select(*keys, stamp.alias("ts"), *PRICE_COLUMNS)


def ticks_to_bars(
    ticks: DataFrame, timeframe: str, keys: list[str] = ["symbol"], order: str = "seq", label: str = "close"
) -> DataFrame:
    """Bars from single prices with ``price``, ``size`` and a numeric arrival order."""
    price = F.col("price")
    as_bars = ticks.select(
        *keys, "ts", order, *[price.alias(c) for c in PRICE_COLUMNS[:4]], F.col("size").alias("volume")
    )
    return resample_bars(as_bars, timeframe, keys, order, label)


def close_labeled(df: DataFrame, timeframe: str) -> DataFrame:
    """Move start labels to the moment each bar is known."""
    return df.withColumn("ts", Timeframe(timeframe).close_label(F.col("ts")))


def fill_missing_bars(df: DataFrame, timeframe: str, keys: list[str] = ["symbol"]) -> DataFrame:
    """Fill holes between the first and last bar of each day on the day's own grid.

    The grid starts at the day's first bar; bars off the grid are dropped. A filled bar repeats the
    last close with volume 0 and is flagged ``imputed``, as is a bar without a close. Daily and
    coarser bars pass unchanged. All windows are bounded by one series' day.
    """
    tf = Timeframe(timeframe)
    if tf.seconds >= 86400:
        return df.select(*keys, "ts", *PRICE_COLUMNS).withColumn("imputed", F.lit(False))
    step = tf.seconds
    day = Window.partitionBy(*keys, "_day")
    in_order = day.orderBy("ts")
    offset = epoch_seconds(F.col("ts")) - epoch_seconds(F.col("_first"))
    on_grid = (
        df.select(*keys, "ts", *PRICE_COLUMNS)
        .withColumn("_day", F.to_date("ts"))
        .withColumn("_first", F.min("ts").over(day))
        .withColumn("_last", F.max("ts").over(day))
        .filter(
            (F.pmod(offset, F.lit(step)) == 0)
            & (F.col("ts") == F.col("_first") + F.make_dt_interval(secs=offset))
        )
    )
    # Each bar is repeated up to the next one, or up to the day's last bar.
    following = F.lead("ts").over(in_order)
    room = F.floor((epoch_seconds(F.coalesce("_next", "_last")) - epoch_seconds(F.col("ts"))) / step)
    copies = F.when(F.col("_next").isNull(), room).otherwise(room - 1)
    spread = (
        on_grid.withColumn("_next", following)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
        .withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("_copy") * step))
    )
    real = F.col("_copy") == 0
    imputed = ~real | F.col("close").isNull()
    carried = F.last(F.when(real, F.col("close")), ignorenulls=True).over(
        in_order.rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = spread.withColumn("imputed", imputed).withColumn("_carried", carried)
    price = {c: F.when(F.col("imputed"), F.col("_carried")).otherwise(F.col(c)).alias(c) for c in PRICE_COLUMNS[:4]}
    volume = F.when(real, F.coalesce("volume", F.lit(0.0))).otherwise(0.0).alias("volume")
    return filled.filter(F.col("_carried").isNotNull()).select(*keys, "ts", *price.values(), volume, "imputed")
