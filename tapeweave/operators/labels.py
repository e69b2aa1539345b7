"""Triple-barrier labels: which of two price barriers is touched first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.functions.touch import Extremes
from tapeweave.operators.indicators import feature_blocks
from tapeweave.operators.series import INDEX, Blocks


def barrier_columns(
    blocks: Blocks, horizon: int, take_profit_atr: float, stop_loss_atr: float, atr: str = "atr"
) -> Blocks:
    """Add ``label``, ``ret`` and ``touched`` to blocks with ``horizon`` rows of halo ahead.

    Without a full horizon or a positive ATR the label is NULL and ``touched`` empty. If both
    barriers fall in one bar the stop counts.
    """
    order = blocks.window()
    ahead = blocks.rows(1, horizon)
    blocks = blocks.columns({
        "_ahead": F.collect_list(F.struct("high", "low")).over(ahead),
        "_end": F.lead("close", horizon).over(order),
    })
    close = F.col("close")
    upper = close + take_profit_atr * F.col(atr)
    lower = close - stop_loss_atr * F.col(atr)
    blocks = blocks.columns({"_upper": upper, "_lower": lower})
    touching = F.filter("_ahead", lambda bar: (bar["high"] >= F.col("_upper")) | (bar["low"] <= F.col("_lower")))
    blocks = blocks.columns({"_touch": F.when(F.col(atr) > 0, F.get(touching, F.lit(0)))})
    usable = (F.col(atr) > 0) & F.col("_end").isNotNull()
    stopped = F.col("_touch")["low"] <= F.col("_lower")
    taken = F.col("_touch").isNotNull()
    pick = lambda stop, take, none: F.when(stopped, stop).when(taken, take).otherwise(none)
    return blocks.columns({
        "label": F.when(usable, pick(F.lit(-1), F.lit(1), F.lit(0))),
        "ret": F.when(usable, pick(F.col("_lower"), F.col("_upper"), F.col("_end")) / close - 1.0),
        "touched": F.when(usable, pick(F.lit("sl"), F.lit("tp"), F.lit("vertical"))).otherwise(""),
    })


def triple_barrier_labels(
    bars: DataFrame,
    timeframe: str,
    horizon: int = 12,
    take_profit_atr: float = 2.0,
    stop_loss_atr: float = 1.0,
    atr_window: int = 14,
    keys: list[str] = ["symbol"],
) -> DataFrame:
    """Close-labelled bars plus the label columns."""
    blocks = feature_blocks(bars, timeframe, ["atr"], keys, atr_window, ahead=horizon)
    blocks = barrier_columns(blocks, horizon, take_profit_atr, stop_loss_atr)
    return blocks.own().select(*bars.drop(INDEX).columns, "label", "ret", "touched")


def label_settings(
    bars: DataFrame, timeframe: str, settings: list[tuple[float, float]], horizon: int = 12, atr_window: int = 14, keys: list[str] = ["symbol"],
) -> DataFrame:
    """(keys, ts, labels): the classes of close-labelled bars under many (take, stop) settings, from one scan ahead.

    Each block's tables of running extremes are built once and descended for every setting. Bars without a full
    horizon or a positive ATR have no row, whatever the setting.
    """
    blocks = feature_blocks(bars, timeframe, ["atr"], keys, atr_window, ahead=horizon)
    blocks = blocks.columns({"_usable": (F.col("atr") > 0) & F.lead("close", horizon).over(blocks.window()).isNotNull()})
    rows = blocks.df.select(*keys, "ts", "_blk", INDEX, "high", "low", "close", "atr", (F.col("_own") & F.col("_usable")).alias("_usable"))
    schema = T.StructType([*[rows.schema[k] for k in keys], rows.schema["ts"], T.StructField("labels", T.ArrayType(T.IntegerType()))])

    def label(block: pa.Table) -> pa.Table:
        block = block.sort_by(INDEX)
        high, low, close, atr = (block[c].to_numpy().astype(float) for c in ("high", "low", "close", "atr"))
        at = np.flatnonzero(pc.fill_null(block["_usable"], False).to_numpy())
        tables, ahead = Extremes(high, low, horizon), np.full(at.size, horizon)
        out = np.ones((at.size, len(settings)), np.int32)
        for k, (take, stop) in enumerate(settings):
            lower, upper = close[at] - stop * atr[at], close[at] + take * atr[at]
            passed, _ = tables.first(at + 1, ahead, lower, upper)
            hit = passed < ahead
            first = np.minimum(at + 1 + passed, close.size - 1)
            out[hit, k] = np.where(low[first] <= lower, 0, 2)[hit]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(at.size + 1) * len(settings), pa.int32()), pa.array(out.ravel()))
        return block.select([*keys, "ts"]).take(pa.array(at)).append_column("labels", lists)

    return rows.groupBy(*keys, "_blk").applyInArrow(label, schema)


def to_class(label: Column) -> Column:
    """-1, 0, 1 to class 0, 1, 2."""
    return (label + 1).cast("int")


def from_class(index: Column) -> Column:
    return (index - 1).cast("int")
