"""Window tensors: the last bars of several timeframes at every sample, without a copy of the bars per sample.

The bars of a timeframe are packed once into one array per block of rows, led by the rows that windows reach back
to. A window is then a pointer (block, offset). Pointers are joined point in time; the array is fetched by an
equi-join and sliced only where the cells are wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.operators.asof import asof_join
from tapeweave.operators.indicators import FEATURE_COLUMNS, counting_span
from tapeweave.operators.labels import to_class, triple_barrier_labels
from tapeweave.operators.samples import clean_features, timeframe_features
from tapeweave.operators.series import INDEX
from tapeweave.session import materialize, require_rows


@dataclass(frozen=True)
class PackedBars:
    """Bars of one timeframe: ``blocks`` (keys, ``block``, ``cells``) and ``pointers`` (keys, ``ts``, ``block``, ``offset``).

    ``cells`` is an array of rows, each an array of the features in order; the window of a pointer is ``window``
    rows from 0-based ``offset`` on. Bars without a full window have no pointer.
    """

    blocks: DataFrame
    pointers: DataFrame
    window: int


def pack_bars(df: DataFrame, features: list[str], window: int, keys: list[str] = ["symbol"]) -> PackedBars:
    """Pack an indexed, cleaned feature frame; every bar is stored twice, however long the window.

    A block holds ``window`` rows and the ``window - 1`` before them, so an array's size is fixed and a hot series
    becomes many blocks.
    """
    if window < 1:
        raise ValueError("a window holds at least one bar")
    home = F.floor(F.col(INDEX) / window)
    late = F.pmod(F.col(INDEX), F.lit(window)) > 0  # its window reaches back from the next block
    homes = F.array_compact(F.array(home, F.when(late, home + 1)))
    cells = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(*keys, "ts", F.col(INDEX), home.alias("_home"), F.explode(homes).alias("block"), cells.alias("cells"))
    blocks = rows.groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list(F.struct(INDEX, "cells"))).alias("_rows"), F.max(F.col("_home") == F.col("block")).alias("_used")
    )
    blocks = blocks.filter("_used").select(*keys, "block", F.col("_rows.cells").alias("cells"))
    first = F.greatest(F.lit(0), home * window - (window - 1))
    pointers = df.filter(F.col(INDEX) >= window - 1).select(
        *keys, "ts", home.alias("block"), (F.col(INDEX) - (window - 1) - first).cast("int").alias("offset")
    )
    return PackedBars(materialize(blocks), pointers, window)


def point_windows(left: DataFrame, packed: dict[str, PackedBars], block_seconds: int, keys: list[str] = ["symbol"]) -> DataFrame:
    """Left rows with ``block_<timeframe>`` and ``offset_<timeframe>`` of the last full window at or before their time.

    Rows without a full window on every timeframe drop out.
    """
    joined = asof_join(left, {tf: p.pointers for tf, p in packed.items()}, keys, block_seconds=block_seconds)
    return joined.dropna(subset=[f"block_{tf}" for tf in packed])


def fetch_windows(pointed: DataFrame, packed: dict[str, PackedBars], keys: list[str] = ["symbol"]) -> DataFrame:
    """The pointers replaced by ``window_<timeframe>``: arrays of ``window`` rows, the oldest first.

    The array of a block is sliced in the task that joins it, so what moves on is the window alone.
    """
    for tf, p in packed.items():
        blocks = p.blocks.select(*keys, F.col("block").alias(f"block_{tf}"), F.col("cells").alias("_cells"))
        pointed = pointed.join(blocks, [*keys, f"block_{tf}"]).withColumn(
            f"window_{tf}", F.slice("_cells", F.col(f"offset_{tf}") + 1, p.window)
        ).drop("_cells", f"block_{tf}", f"offset_{tf}")
    return pointed


def pack_timeframes(
    base: DataFrame, base_timeframe: str, context_timeframes: list[str], window: int = 64, horizon: int = 12,
    take_profit_atr: float = 2.0, stop_loss_atr: float = 1.0, features: list[str] = FEATURE_COLUMNS,
    keys: list[str] = ["symbol"], atr_window: int = 14, require_label: bool = True,
) -> tuple[DataFrame, dict[str, PackedBars]]:
    """Labelled bars with their pointers (keys, ts, label, ret, block and offset per timeframe), and the packed bars.

    Windows end at the last bar that was closed at the row's time; a row needs a full one on every timeframe.
    Raises if no series gives a row.
    """
    frames = timeframe_features(base, context_timeframes, base_timeframe, list(dict.fromkeys([*features, "atr"])), keys, atr_window)
    bars = frames[base_timeframe].select(*keys, "ts", "open", "high", "low", "close", "volume")
    labelled = triple_barrier_labels(bars, base_timeframe, horizon, take_profit_atr, stop_loss_atr, atr_window, keys)
    labelled = labelled.filter("label IS NOT NULL") if require_label else labelled
    rows = labelled.select(*keys, "ts", to_class(F.col("label")).alias("label"), "ret")
    packed = {tf: pack_bars(clean_features(frames[tf], features, tf, keys), features, window, keys) for tf in frames if tf in context_timeframes}
    pointed = materialize(point_windows(rows, packed, counting_span(base_timeframe), keys))
    return require_rows(pointed), packed


def build_tensors(base: DataFrame, base_timeframe: str, context_timeframes: list[str], keys: list[str] = ["symbol"], **options) -> DataFrame:
    """Samples with one ``window_<timeframe>`` array (bars by features) per timeframe; options as ``pack_timeframes``."""
    pointed, packed = pack_timeframes(base, base_timeframe, context_timeframes, keys=keys, **options)
    return fetch_windows(pointed, packed, keys)
