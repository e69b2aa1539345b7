"""Training samples: cleaned multi-timeframe windows, scaling, chronological splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.arith import finite
from tapeweave.functions.timeframes import sort_labels
from tapeweave.operators.asof import asof_join
from tapeweave.operators.bars import close_labeled, fill_missing_bars, resample_bars
from tapeweave.operators.indicators import FEATURE_COLUMNS, add_indicators, counting_span
from tapeweave.operators.labels import barrier_columns, to_class
from tapeweave.operators.scan import block_scan, range_blocks, time_block
from tapeweave.operators.series import INDEX, Blocks, row_blocks
from tapeweave.schemas import PRICE_COLUMNS
from tapeweave.session import materialize, materialize_all, require_rows


def timeframe_bars(filled: DataFrame, timeframe: str, base_timeframe: str, keys: list[str] = ["symbol"]) -> DataFrame:
    """Close-labelled bars of one timeframe from filled, start-labelled base bars."""
    if timeframe == base_timeframe:
        return close_labeled(filled, timeframe).select(*keys, "ts", *PRICE_COLUMNS)
    return resample_bars(filled, timeframe, keys)


def timeframe_features(
    base: DataFrame,
    timeframes: list[str],
    base_timeframe: str,
    features: list[str] = FEATURE_COLUMNS,
    keys: list[str] = ["symbol"],
    atr_window: int = 14,
) -> dict[str, DataFrame]:
    """One stored feature frame per timeframe; the filled base is written once and shared."""
    filled = materialize(fill_missing_bars(base, base_timeframe, keys))
    return materialize_all({
        tf: add_indicators(timeframe_bars(filled, tf, base_timeframe, keys), tf, features, keys, atr_window)
        for tf in sort_labels(list(dict.fromkeys([*timeframes, base_timeframe])))
    })


def clean_features(df: DataFrame, features: list[str], timeframe: str, keys: list[str] = ["symbol"]) -> DataFrame:
    """Infinite and missing values become the last seen value, and 0 before there is one."""
    scans = {c: ("last", finite(F.col(c).cast("double"))) for c in features}
    filled = block_scan(df, keys, ["ts"], [time_block("ts", counting_span(timeframe))], scans)
    return filled.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in features})


def window_arrays(df: DataFrame, features: list[str], window: int, keys: list[str] = ["symbol"]) -> DataFrame:
    """The last ``window`` rows' features as an array; rows without a full window drop out."""
    blocks = row_blocks(df, keys, back=window - 1)
    bars = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(blocks.rows(-(window - 1), 0))
    return (
        blocks.columns({"window": bars}).own()
        .filter(F.col(INDEX) >= window - 1)
        .select(*keys, "ts", "window")
    )


def _window_stats(blocks: Blocks, features: list[str], window: int) -> Blocks:
    """Add last value, mean and variance of each feature over the last ``window`` rows.

    Differences of running sums over the block, so the cost per row does not grow with the window.
    Values are centred on the block's mean first, which keeps the differences accurate.
    """
    whole = blocks.rows(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = blocks.rows(Window.unboundedPreceding, 0)
    blocks = blocks.columns({f"_mid_{c}": F.avg(c).over(whole) for c in features})
    off = lambda c: F.col(c) - F.col(f"_mid_{c}")
    blocks = blocks.columns(
        {f"_sum_{c}": F.sum(off(c)).over(so_far) for c in features}
        | {f"_sq_{c}": F.sum(off(c) * off(c)).over(so_far) for c in features}
    )
    recent = lambda c: (F.col(c) - F.lag(c, window, 0.0).over(blocks.window())) / window
    blocks = blocks.columns(
        {f"_m1_{c}": recent(f"_sum_{c}") for c in features} | {f"_m2_{c}": recent(f"_sq_{c}") for c in features}
    )
    stats = {f"{c}_last": F.col(c).cast("double") for c in features}
    stats |= {f"{c}_mean": F.col(f"_mid_{c}") + F.col(f"_m1_{c}") for c in features}
    stats |= {
        f"{c}_var": F.greatest(F.col(f"_m2_{c}") - F.col(f"_m1_{c}") * F.col(f"_m1_{c}"), F.lit(0.0)) for c in features
    }
    return blocks.columns(stats)


def _stat_names(features: list[str]) -> list[str]:
    return [f"{c}_{kind}" for kind in ("last", "mean", "var") for c in features]


def flat_features(df: DataFrame, features: list[str], window: int, keys: list[str] = ["symbol"]) -> DataFrame:
    """Last value, mean and variance of each feature over the last ``window`` rows; rows without a
    full window drop out. ``df`` is an indexed, cleaned feature frame."""
    blocks = _window_stats(row_blocks(df, keys, back=window - 1), features, window)
    return blocks.own().filter(F.col(INDEX) >= window - 1).select(*keys, "ts", *_stat_names(features))


def build_samples(
    base: DataFrame,
    base_timeframe: str,
    context_timeframes: list[str],
    window: int = 64,
    horizon: int = 12,
    take_profit_atr: float = 2.0,
    stop_loss_atr: float = 1.0,
    features: list[str] = FEATURE_COLUMNS,
    keys: list[str] = ["symbol"],
    atr_window: int = 14,
    require_label: bool = True,
) -> DataFrame:
    """Labelled samples of all symbols from start-labelled base bars.

    Each row holds, per timeframe and feature, the last value, mean and variance over the
    ``window`` bars that were closed at the row's time; a row needs a full window on every
    timeframe. ``require_label=False`` also keeps the last ``horizon`` bars, for scoring. The samples are stored;
    raises if no series gives one.
    """
    wanted = list(dict.fromkeys([*features, "atr"]))
    frames = timeframe_features(base, context_timeframes, base_timeframe, wanted, keys, atr_window)

    base_rows = frames[base_timeframe].withColumn("atr_raw", F.col("atr"))
    cleaned = clean_features(base_rows, features, base_timeframe, keys)
    blocks = row_blocks(cleaned, keys, back=window - 1, ahead=horizon)
    own = base_timeframe in context_timeframes
    blocks = _window_stats(blocks, features, window) if own else blocks
    blocks = barrier_columns(blocks, horizon, take_profit_atr, stop_loss_atr, "atr_raw")
    rows = blocks.own()
    rows = rows.filter(F.col(INDEX) >= window - 1) if own else rows
    rows = rows.filter(F.col("label").isNotNull()) if require_label else rows
    rows = rows.select(
        *keys, "ts", "close", to_class(F.col("label")).alias("label"), "ret",
        *[F.col(c).alias(f"{c}_{base_timeframe}") for c in (_stat_names(features) if own else [])],
    )

    rights = {}
    for tf, frame in frames.items():
        if tf == base_timeframe or tf not in context_timeframes:
            continue
        clean = clean_features(frame, features, tf, keys)
        rights[tf] = flat_features(clean, features, window, keys)
    if rights:
        rows = asof_join(rows, rights, keys, block_seconds=counting_span(base_timeframe))
        rows = rows.dropna(subset=[f"{features[0]}_last_{tf}" for tf in rights])
    return require_rows(materialize(rows))


def sample_timeframes(samples: DataFrame, feature: str) -> list[str]:
    head = f"{feature}_last_"
    return [c[len(head):] for c in samples.columns if c.startswith(head)]


def model_columns(features: list[str], timeframes: list[str]) -> list[str]:
    return [f"{c}_{kind}_{tf}" for tf in timeframes for kind in ("last", "mean") for c in features]


def _spread(feature: str, timeframes: list[str]) -> tuple[Column, Column]:
    """Mean and population deviation over all window values of all samples and timeframes.

    From window means and variances: a bar counts once per window that holds it, and no window
    has to be unrolled.
    """
    means = [F.avg(f"{feature}_mean_{tf}") for tf in timeframes]
    mean = sum(means[1:], means[0]) / len(timeframes)
    parts = [
        F.avg(f"{feature}_var_{tf}") + F.var_pop(f"{feature}_mean_{tf}") + F.pow(m - mean, F.lit(2.0))
        for tf, m in zip(timeframes, means)
    ]
    std = F.sqrt(sum(parts[1:], parts[0]) / len(timeframes))
    return mean, F.when(std < 1e-8, 1.0).otherwise(std)


def scaler_stats(samples: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std) of a training set, in one aggregate."""
    timeframes = sample_timeframes(samples, features[0])
    stats = {c: _spread(c, timeframes) for c in features}
    row = samples.agg(*[F.struct(m.alias("mean"), s.alias("std")).alias(c) for c, (m, s) in stats.items()])
    return row.unpivot([], features, "feature", "stat").select("feature", "stat.mean", "stat.std")


def apply_scaler(samples: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """Scaled last and mean columns. ``stats`` has one row per feature and is read once."""
    return scale_columns(samples, {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}, features)


def scale_columns(samples: DataFrame, stats: dict[str, tuple[float, float]], features: list[str]) -> DataFrame:
    """The same with (mean, std) by feature at hand."""
    timeframes = sample_timeframes(samples, features[0])
    scaled = {
        f"{c}_{kind}_{tf}": (F.col(f"{c}_{kind}_{tf}") - stats[c][0]) / stats[c][1]
        for c in features for kind in ("last", "mean") for tf in timeframes
    }
    return samples.withColumns(scaled)


@dataclass(frozen=True)
class BlockMoments:
    """What scalers of any run of fold blocks need, one entry per block, feature and timeframe."""

    n: np.ndarray  # blocks
    mean: np.ndarray  # blocks x features x timeframes: averages of the window means
    spread: np.ndarray  # the same: squared deviations of the window means from their average, summed
    inside: np.ndarray  # the same: variances inside the windows, summed

    def stats(self, features: list[str], low: int, high: int) -> dict[str, tuple[float, float]]:
        """(mean, std) by feature of the samples of blocks ``low`` to ``high - 1``, as ``scaler_stats`` gives them."""
        some = slice(low, high)
        n = self.n[some, None, None]
        total = n.sum()
        mean = (n * self.mean[some]).sum(0) / total
        between = (self.spread[some] + n * (self.mean[some] - mean) ** 2).sum(0) / total
        center = mean.mean(1, keepdims=True)
        std = np.sqrt((self.inside[some].sum(0) / total + between + (mean - center) ** 2).mean(1))
        return {c: (float(m), 1.0 if s < 1e-8 else float(s)) for c, m, s in zip(features, center[:, 0], std)}


def block_moments(samples: DataFrame, features: list[str], blocks: int, block: str = "block") -> BlockMoments:
    """The moments of every fold block, in one aggregate whatever the number of folds."""
    timeframes = sample_timeframes(samples, features[0])
    names = [(c, tf) for c in features for tf in timeframes]
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, (c, tf) in enumerate(names):
        means = F.col(f"{c}_mean_{tf}")
        aggregates += [F.avg(means).alias(f"m{i}"), F.var_pop(means).alias(f"v{i}"), F.sum(f"{c}_var_{tf}").alias(f"s{i}")]
    shape = (blocks, len(features), len(timeframes))
    n, mean, spread, inside = np.zeros(blocks), np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for row in samples.groupBy(block).agg(*aggregates).collect():
        k = row[block]
        n[k] = row["n"]
        values = lambda letter: np.array([row[f"{letter}{i}"] for i in range(len(names))], float).reshape(shape[1:])
        mean[k], spread[k], inside[k] = values("m"), values("v") * n[k], values("s")
    return BlockMoments(n, mean, spread, inside)


def chronological_rank(df: DataFrame, order: list[str] = ["ts", "symbol"], out: str = "rank") -> DataFrame:
    """0-based position of each row in one global order, without a global sort window.

    Rows are ranked inside their range of the order, and the counts of the ranges are added up.
    """
    ranged = range_blocks(df, order)
    ranked = block_scan(ranged, [], order, [F.col("_range")], {out: ("count", F.lit(1))})
    return ranked.withColumn(out, F.col(out) - 1).drop("_range")


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def temporal_split(df: DataFrame, val_fraction: float = 0.2, order: list[str] = ["ts", "symbol"]) -> DataFrame:
    """Add ``role``: the earliest rows are ``train``, the rest ``val``."""
    cut = F.floor(_row_count(df) * (1.0 - val_fraction))
    return chronological_rank(df, order).withColumn("role", F.when(F.col("rank") < cut, "train").otherwise("val"))


def block_edges(n: int, n_splits: int) -> list[int]:
    """First ranks of the ``n_splits + 1`` blocks that folds are made of, with the end."""
    if n_splits < 1:
        raise ValueError("n_splits must be at least 1")
    return [int(i * (n / (n_splits + 1))) for i in range(n_splits + 1)] + [n]


def fold_blocks(edges: list[int], expanding: bool = True) -> list[tuple[int, int]]:
    """(fold, first training block) of the folds that have rows on both sides: fold k trains up to block k - 1 and validates on block k."""
    folds = [(k, 0 if expanding else k - 1) for k in range(1, len(edges) - 1)]
    return [(k, low) for k, low in folds if edges[low] < edges[k] < edges[k + 1]]


def with_fold_block(ranked: DataFrame, edges: list[int], out: str = "block") -> DataFrame:
    """Ranked samples with the number of their block."""
    block = F.lit(0)
    for edge in edges[1:-1]:
        block = block + (F.col("rank") >= edge).cast("int")
    return ranked.withColumn(out, block)


def walk_forward_folds(
    df: DataFrame, n_splits: int = 4, expanding: bool = True, order: list[str] = ["ts", "symbol"]
) -> DataFrame:
    """One row per (fold, role, sample): each fold validates on the block after its training blocks."""
    if n_splits < 1:
        raise ValueError("n_splits must be at least 1")
    ranked = chronological_rank(df, order).withColumn("_n", _row_count(df))
    bounds = [F.floor(i * (F.col("_n") / (n_splits + 1))) for i in range(n_splits + 1)] + [F.col("_n")]
    rank, roles = F.col("rank"), []
    for i in range(1, n_splits + 1):
        low, cut, high = (F.lit(0) if expanding else bounds[i - 1]), bounds[i], bounds[i + 1]
        usable = (low < cut) & (cut < high)
        role = F.when((rank >= low) & (rank < cut), "train").when((rank >= cut) & (rank < high), "val")
        roles.append(F.when(usable & role.isNotNull(), F.struct(F.lit(i).alias("fold"), role.alias("role"))))
    return ranked.withColumn("_role", F.explode(F.array_compact(F.array(*roles)))).select(
        "_role.fold", "_role.role", *df.columns, "rank"
    )


def class_weights(df: DataFrame, label: str = "label", n_classes: int = 3) -> DataFrame:
    """(label, weight): rows over classes times class count; an absent class counts as one row."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(label) == k).alias(f"c{k}") for k in range(n_classes)],
    )
    rows = F.array(*[
        F.struct(F.lit(k).alias("label"), F.col("n").alias("n"), F.col(f"c{k}").alias("count")) for k in range(n_classes)
    ])
    return counted.select(F.inline(rows)).select(
        "label", "count", (F.col("n") / (n_classes * F.greatest("count", F.lit(1)))).alias("weight")
    )
