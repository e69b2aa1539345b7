"""Equity curve, drawdown and summary measures of a trade ledger."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.arith import zero_null
from tapeweave.operators.scan import range_blocks

EXIT_ORDER = ["exit_time", "signal_ts", "symbol"]


def _climb(df: DataFrame, keys: list[str], order: list[str], blocks: list[Column], gain: str, top: str) -> DataFrame:
    """Add ``_before``, the sum of gains before each row, and ``_peak``, the highest level reached so
    far by any row's ``_before + top``.

    A blocked scan of both at once: blocks report their gain and their highest level, the reports
    are scanned across blocks, and each row adds what came before its block.
    """
    names = [f"_block{len(blocks)}_{i}" for i in range(len(blocks))]
    within = Window.partitionBy(*keys, *names).orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        df.withColumns(dict(zip(names, blocks)))
        .withColumn("_in", F.coalesce(F.sum(gain).over(earlier), F.lit(0.0)))
        .withColumn("_up", F.max(F.col("_in") + F.col(top)).over(so_far))
    )
    totals = local.groupBy(*keys, *names).agg(F.sum(gain).alias("_gain"), F.max("_up").alias("_top"))
    if len(blocks) == 1:
        across = Window.partitionBy(*keys).orderBy(names[0]).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.withColumn("_start", F.coalesce(F.sum("_gain").over(across), F.lit(0.0))).withColumn(
            "_high", F.max(F.col("_start") + F.col("_top")).over(across)
        )
    else:
        climbed = _climb(totals, keys, names, [F.col(n) for n in names[:-1]], "_gain", "_top")
        carried = climbed.withColumn("_start", F.col("_before")).withColumn("_high", F.col("_peak_before"))
    carried = carried.select(*keys, *names, "_start", "_high")
    out = local.withColumn("_last", F.lag("_up").over(within)).join(carried, [*keys, *names], "left")
    return out.withColumns({
        "_before": F.col("_start") + F.col("_in"),
        "_peak": F.greatest(F.col("_high"), F.col("_start") + F.col("_up")),
        "_peak_before": F.greatest(F.col("_high"), F.col("_start") + F.col("_last")),
    }).drop(*names, "_in", "_up", "_last", "_start", "_high")


def equity_curve(ledger: DataFrame, initial: float = 100_000.0, by: list[str] = []) -> DataFrame:
    """Ledger with ``equity`` after each exit, ``peak`` so far, ``drawdown``, and the return on the
    equity before the trade. Order: exit time, then signal time and symbol. Trades are summed
    inside ranges of that order, and the ranges in a row."""
    ranged = range_blocks(ledger, [*by, *EXIT_ORDER])
    climbed = _climb(ranged, by, EXIT_ORDER, [F.col("_range")], "pnl", "pnl").drop("_range")
    before = initial + F.col("_before")
    return climbed.withColumns({
        "equity": before + F.col("pnl"),
        "peak": F.greatest(F.lit(initial), initial + F.col("_peak")),
        "return_pct": F.coalesce(F.col("pnl") / zero_null(before), F.lit(0.0)),
    }).withColumn("drawdown", (F.col("equity") - F.col("peak")) / zero_null("peak")).drop("_before", "_peak", "_peak_before")


def max_drawdown(curve: DataFrame, by: list[str] = []) -> DataFrame:
    """Largest fall from a peak, as a fraction at or below 0."""
    return curve.groupBy(*by).agg(F.coalesce(F.least(F.min("drawdown"), F.lit(0.0)), F.lit(0.0)).alias("max_drawdown"))


def trade_metrics(
    curve: DataFrame, initial: float = 100_000.0, periods_per_year: float = 252.0, by: list[str] = []
) -> DataFrame:
    """One row of measures per group, from an equity curve frame."""
    r = F.col("return_pct")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    spread = zero_null(F.stddev_samp(r))
    wins, losses = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))
    factor = F.when(zero(losses) > 0, zero(wins) / zero_null(losses)).when(zero(wins) > 0, F.lit(math.inf)).otherwise(0.0)
    n = F.count(F.lit(1))
    return curve.groupBy(*by).agg(
        n.cast("double").alias("n_trades"),
        zero(F.sum("pnl") / F.lit(initial)).alias("total_return"),
        zero(F.count_if(r > 0) / F.nullif(n, F.lit(0))).alias("win_rate"),
        zero(F.avg(r)).alias("avg_return"),
        factor.alias("profit_factor"),
        zero(math.sqrt(periods_per_year) * F.avg(r) / spread).alias("sharpe"),
        zero(F.least(F.min("drawdown"), F.lit(0.0))).alias("max_drawdown"),
        zero(F.max(r)).alias("best_trade"),
        zero(F.min(r)).alias("worst_trade"),
        zero(F.sum("cost")).alias("total_costs"),
    )


def metrics_rows(metrics: DataFrame, by: list[str] = []) -> DataFrame:
    """(metric, value) rows."""
    values = [c for c in metrics.columns if c not in by]
    return metrics.unpivot(by, values, "metric", "value")
