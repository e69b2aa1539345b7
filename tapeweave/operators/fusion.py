"""Signals and catalysts joined: boosted probabilities and the probability gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.timeframes import epoch_micros
from tapeweave.operators.catalysts import actionable_catalysts
from tapeweave.operators.scan import block_scan

SLICES = 256


def actionable_signals(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("direction") != 0)


def catalyst_boost(
    signals: DataFrame, catalysts: DataFrame, window_seconds: int = 86400, boost: float = 0.15
) -> DataFrame:
    """Signals with ``catalyst_boost``: the largest boost of a catalyst of the same symbol that
    came at most ``window_seconds`` before (both ends count), or 0.

    No pair is formed. Time is cut into spans as long as the window, so each window is the end of
    one span and the start of the next: two running maxima, one forward and one backward in time,
    each scanned in ``SLICES`` slices per span. Rows of one symbol and moment are merged before
    the shuffle.
    """
    width = window_seconds * 1_000_000
    weight = boost * F.col("strength") * F.col("confidence")
    micros = epoch_micros(F.col("ts"))

    def two_ways(forward, backward):
        return F.inline(F.array(*[
            F.struct(F.lit(way).alias("_way"), span.alias("_span"), place.alias("_place"))
            for way, span, place in ((1, *forward), (-1, *backward))
        ]))

    span = F.floor(F.col("_at") / F.lit(width))
    peaks = (
        actionable_catalysts(catalysts).groupBy("symbol", "ts").agg(F.max(weight).alias("_weight"))
        .withColumn("_at", micros)
        .select("symbol", "ts", "_weight", F.lit(0).alias("_side"),
                two_ways((span, F.col("_at")), (span, -F.col("_at"))))
    )
    # A signal reads its own span up to its time, and the span before from one window earlier.
    probes = (
        signals.select("symbol", "ts").distinct().withColumn("_at", micros)
        .select("symbol", "ts", F.lit(None).cast("double").alias("_weight"), F.lit(1).alias("_side"),
                two_ways((span, F.col("_at")), (span - 1, F.lit(width) - F.col("_at"))))
    )
    best = block_scan(
        peaks.unionByName(probes), ["symbol", "_way", "_span"], ["_place", "_side", "ts"],
        [F.floor(F.col("_place") / F.lit(max(1, width // SLICES)))], {"_best": ("max", F.col("_weight"))},
    )
    found = best.filter("_side = 1").groupBy("symbol", "ts").agg(F.max("_best").alias("_best"))
    return (
        signals.join(found, ["symbol", "ts"], "left")
        .withColumn("catalyst_boost", F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0)))
        .drop("_best")
    )


def fuse_signals(
    signals: DataFrame,
    catalysts: DataFrame | None = None,
    min_prob: float = 0.4,
    window_seconds: int = 86400,
    boost: float = 0.15,
) -> DataFrame:
    """Actionable signals with boosted probability, gated once after the boost."""
    acting = actionable_signals(signals)
    if catalysts is None:
        boosted = acting.withColumn("catalyst_boost", F.lit(0.0))
    else:
        boosted = catalyst_boost(acting, catalysts, window_seconds, boost)
    raised = F.when(
        F.col("catalyst_boost") > 0, F.least(F.lit(1.0), F.col("probability") + F.col("catalyst_boost"))
    ).otherwise(F.col("probability"))
    fused = boosted.withColumn("probability", raised).filter(F.col("probability") >= min_prob)
    if "meta" in signals.columns:
        extra = F.create_map(F.lit("catalyst_boost"), F.col("catalyst_boost").cast("string"))
        kept = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, _: k != "catalyst_boost")
        fused = fused.withColumn(
            "meta", F.when(F.col("catalyst_boost") > 0, F.map_concat(kept, extra)).otherwise(F.col("meta"))
        )
    return fused
