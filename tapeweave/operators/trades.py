"""From signals to a trade ledger, as set operations over all symbols at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.functions.costs import Costs, apply_costs
from tapeweave.functions.sizing import Sizing, size_positions
from tapeweave.functions.touch import Extremes
from tapeweave.operators.indicators import add_indicators, counting_span
from tapeweave.operators.series import INDEX, row_blocks, with_row_index
from tapeweave.session import materialize


def trade_bars(bars: DataFrame, timeframe: str, atr_window: int = 14, keys: list[str] = ["symbol"]) -> DataFrame:
    """Numbered bars with their ATR, stored: what signals are opened on and walked along."""
    indexed = with_row_index(bars, keys, span_seconds=counting_span(timeframe))
    return materialize(add_indicators(indexed, timeframe, ["atr"], keys, atr_window).select(
        *keys, "ts", "open", "high", "low", "close", "atr", INDEX
    ))


def open_context(
    bars: DataFrame, signals: DataFrame, max_horizon: int, keys: list[str] = ["symbol"],
) -> DataFrame:
    """Signals that can be traded, with the next bar's number, open and time and the signal bar's ATR.

    ``bars`` come from ``trade_bars``. A signal is matched to its bar by an equi-join on the time.
    ``horizon`` may not exceed ``max_horizon``.
    """
    blocks = row_blocks(bars, keys, ahead=1)
    order = blocks.window()
    blocks = blocks.columns({"entry": F.lead("open").over(order), "entry_time": F.lead("ts").over(order)})
    context = blocks.own().filter(F.col("entry_time").isNotNull() & (F.col("atr") > 0)).select(
        *keys, "ts", F.col(INDEX).alias("bar_index"), "entry", "entry_time", "atr"
    )
    acting = signals.filter(F.col("direction") != 0)
    own = [c for c in acting.columns if c not in context.columns or c in (*keys, "ts")]
    too_far = F.raise_error(F.lit("signal horizon exceeds max_horizon")).cast("int")
    return acting.select(*own).join(context, [*keys, "ts"]).withColumn(
        "horizon", F.when(F.col("horizon") > max_horizon, too_far).otherwise(F.col("horizon"))
    )


def one_per_moment(signals: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """One signal per symbol and time: the most probable, a long before a short on ties."""
    rest = [c for c in signals.columns if c not in (*keys, "ts")]
    best = F.max_by(F.struct(*rest), F.struct("probability", "direction")).alias("best")
    return signals.groupBy(*keys, "ts").agg(best).select(*keys, "ts", "best.*").select(*signals.columns)


def trade_outcomes(
    plans: DataFrame, bars: DataFrame, max_horizon: int, trail_atr_mult: float | None = None, keys: list[str] = ["symbol"],
) -> DataFrame:
    """Exit of each plan: stop, trailing stop, take-profit, or the close at the horizon.

    A plan runs from the bar after its signal for ``horizon`` more bars. The stop is tested before the take-profit;
    a trailing stop is first tightened with the bar's own range. Plans and ``bars`` (from ``trade_bars``) meet block
    by block; there, tables of running extremes are descended to the first touch, so no plan carries its path and
    a plan costs as many steps as its horizon has binary digits.
    """
    read = [*keys, "ts", "high", "low", "close", "atr", INDEX]
    # New names for the same columns, as plans may come from these bars.
    blocks = row_blocks(bars.select(*read).toDF(*read), keys, ahead=max_horizon + 1)
    # More than one plan of a bar is possible, so what a block's plans read is their own columns and nothing else.
    dealt = plans.withColumn("_blk", F.floor(F.col("bar_index") / blocks.rows_each))
    added = "exit double, exit_time timestamp_ntz, exit_index bigint, reason string"
    names = [c for c in plans.columns if c not in ("exit", "exit_time", "exit_index", "reason")]
    schema = T.StructType([*[plans.schema[c] for c in names], *T.StructType.fromDDL(added).fields])
    stop_reason = "trail" if trail_atr_mult else "stop"

    def walk(mine: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by(INDEX)
        number = block[INDEX].to_numpy()
        high, low, close, atr = (block[c].to_numpy().astype(float) for c in ("high", "low", "close", "atr"))
        start = mine["bar_index"].to_numpy() + 1 - (number[0] if number.size else 0)
        long_side = mine["direction"].to_numpy() > 0
        stop, take = (mine[c].to_numpy().astype(float) for c in ("stop", "take_profit"))
        bars_each = np.minimum(mine["horizon"].to_numpy() + 1, number.size - start)
        reach = np.where(atr > 0, (trail_atr_mult or 0.0) * atr, np.inf)
        exit_at, price = np.zeros(len(mine), np.int64), np.zeros(len(mine))
        hit, stopped = np.zeros(len(mine), bool), np.zeros(len(mine), bool)
        for side, some in ((1.0, np.flatnonzero(long_side)), (-1.0, np.flatnonzero(~long_side))):
            if not some.size:
                continue
            # A short is a long on mirrored prices.
            tops, floors = (high, low) if side > 0 else (-low, -high)
            pull = np.where(np.isfinite(reach), tops - reach, -np.inf) if trail_atr_mult else None
            passed, last_stop = Extremes(tops, floors, int(bars_each[some].max()), pull).first(
                start[some], bars_each[some], side * stop[some], side * take[some]
            )
            hit[some] = passed < bars_each[some]
            exit_at[some] = start[some] + np.minimum(passed, bars_each[some] - 1)
            stopped[some] = floors[exit_at[some]] <= last_stop
            price[some] = side * np.where(stopped[some], last_stop, side * take[some])
        reason = np.where(hit, np.where(stopped, stop_reason, "take"), "horizon")
        out = mine.select(names)
        out = out.append_column("exit", pa.array(np.where(hit, price, close[exit_at])))
        out = out.append_column("exit_time", block["ts"].take(pa.array(exit_at)))
        return out.append_column("exit_index", pa.array(number[exit_at])).append_column("reason", pa.array(reason, pa.string()))

    return dealt.groupBy(*keys, "_blk").cogroup(blocks.df.groupBy(*keys, "_blk")).applyInArrow(
        lambda mine, block: walk(mine, block) if len(mine) else empty_rows(mine, names), schema
    )


def empty_rows(table: pa.Table, names: list[str]) -> pa.Table:
    """No outcome, for a block of bars without plans."""
    out = table.select(names)
    for name, kind in (("exit", pa.float64()), ("exit_time", pa.timestamp("us")), ("exit_index", pa.int64()), ("reason", pa.string())):
        out = out.append_column(name, pa.array([], kind))
    return out


SELECTION_ROWS = 1024


#: Blocks whose maps are put together in one step.
CHAINED = 64


def block_starts(maps: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, _blk, _busy): what every block of a series starts with, if the first starts with 0.

    ``maps`` has for each block (keys, ``_blk``) the array ``_map`` of what it hands on for each start from 0 to
    ``most``; a missing block hands on 0. ``CHAINED`` neighbours at a time are put together into the map of
    their group, and those of groups again, until a series is one group; then the starts are handed back down. So
    no task walks a series, and the steps grow with the logarithm of its blocks.
    """
    levels = [materialize(maps)]
    while (levels[-1].agg(F.max("_blk")).first()[0] or 0) > 0:
        levels.append(materialize(_grouped_maps(levels[-1], keys).select(
            *keys, "_blk", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long")), lambda s: _handed_on(s)["busy"]).alias("_map")
        )))
    starts = levels[-1].select(*keys, "_blk", F.lit(0).cast("long").alias("_busy"))
    for below in reversed(levels[:-1]):
        met = _grouped_maps(below, keys).join(starts, [*keys, "_blk"]).select(*keys, F.explode(_handed_on(F.col("_busy"))["met"]).alias("x"))
        starts = met.select(*keys, "x.*")
    return starts


def _grouped_maps(maps: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group of ``CHAINED`` neighbouring blocks, with their numbers and maps in order."""
    group = F.floor(F.col("_blk") / CHAINED)
    return maps.groupBy(*keys, group.alias("_group")).agg(F.sort_array(F.collect_list(F.struct("_blk", "_map"))).alias("_maps")).withColumnRenamed("_group", "_blk")


def _handed_on(start):
    """What a group hands on from ``start`` (``busy``), and what each of its blocks starts with (``met``)."""
    first = F.col("_blk") * CHAINED
    state = "struct<at:bigint,busy:bigint,met:array<struct<_blk:bigint,_busy:bigint>>>"

    def step(acc, block):
        busy = F.when(block["_blk"] == acc["at"], acc["busy"]).otherwise(F.lit(0).cast("long"))  # a gap frees the series
        met = F.concat(acc["met"], F.array(F.struct(block["_blk"].alias("_blk"), busy.alias("_busy"))))
        return F.struct((block["_blk"] + 1).alias("at"), F.get(block["_map"], busy.cast("int")).alias("busy"), met.alias("met")).cast(state)

    begin = F.struct(first.alias("at"), start.cast("long").alias("busy"), F.array().alias("met")).cast(state)
    end = lambda acc: F.struct(
        F.when(acc["at"] == first + CHAINED, acc["busy"]).otherwise(F.lit(0).cast("long")).alias("busy"), acc["met"].alias("met")
    )
    return F.aggregate("_maps", begin, step, end)


def single_position(
    trades: DataFrame, max_bars: int, keys: list[str] = ["symbol"], block_bars: int = SELECTION_ROWS
) -> DataFrame:
    """Trades kept when a symbol may hold one position at a time, chosen greedily in time order.

    ``trades`` holds at most one trade per symbol and signal bar. A trade is kept if its signal bar (``bar_index``) is not before the exit bar (``exit_index``)
    of the last kept one. No trade may last more than ``max_bars`` bars after its signal (one that does raises), so all that
    passes from one block of bars to the next is how many of its bars are still taken: a number up
    to ``max_bars``. Each block is walked once for every such number, which gives a small map; the
    maps of a series are chained; then each block is walked from its true start. The trades are
    read three times: pass a stored frame.
    """
    size = max(block_bars, max_bars)
    block = F.floor(F.col("bar_index") / size)
    lasts = F.col("exit_index") - F.col("bar_index")
    late = F.raise_error(F.concat(F.lit(f"a trade lasts more than {max_bars} bars: "), lasts)).cast("long")
    checked = F.when(lasts > max_bars, late).otherwise(F.col("exit_index"))
    base = trades.withColumns({"exit_index": checked, "_blk": block})
    packed = base.groupBy(*keys, "_blk").agg(
        F.sort_array(F.collect_list(F.struct(F.col("bar_index").alias("at"), F.col("exit_index").alias("until")))).alias("_walk")
    )
    walk_from = lambda start: F.aggregate(
        "_walk", start, lambda free, t: F.when(t["at"] >= free, t["until"]).otherwise(free)
    )
    first_bar = F.col("_blk") * size
    late = lambda busy: F.greatest(walk_from(first_bar + busy) - (first_bar + size), F.lit(0).cast("long"))
    maps = packed.select(
        *keys, "_blk", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max_bars).cast("long")), late).alias("_map")
    )

    starts = block_starts(maps, keys, max_bars)

    chosen = F.aggregate(
        "_walk",
        F.struct((first_bar + F.col("_busy")).alias("free"), F.array().cast("array<bigint>").alias("kept")),
        lambda acc, t: F.when(
            t["at"] >= acc["free"],
            F.struct(t["until"].alias("free"), F.concat(acc["kept"], F.array(t["at"])).alias("kept")),
        ).otherwise(acc),
    )["kept"]
    kept = packed.join(starts, [*keys, "_blk"]).select(*keys, F.explode(chosen).alias("bar_index"))
    return trades.join(kept, [*keys, "bar_index"], "left_semi")


def trade_ledger(
    bars: DataFrame,
    signals: DataFrame,
    timeframe: str,
    equity: float = 100_000.0,
    sizing: Sizing = Sizing(),
    costs: Costs = Costs(),
    max_horizon: int = 12,
    trail_atr_mult: float | None = None,
    min_prob: float = 0.0,
    atr_window: int = 14,
    one_per_symbol: bool = True,
) -> DataFrame:
    """The trades of a signal set: planned, walked to their exits, costed, one per symbol at a time.

    Sizes use the stated equity throughout; results do not compound.
    """
    gated = signals.filter((F.col("direction") != 0) & (F.col("probability") >= min_prob))
    gated = one_per_moment(gated) if one_per_symbol else gated
    walked = trade_bars(bars, timeframe, atr_window)
    plans = size_positions(open_context(walked, gated, max_horizon), equity, sizing)
    trades = apply_costs(trade_outcomes(plans, walked, max_horizon, trail_atr_mult), costs)
    if one_per_symbol:
        # The choice reads its trades more than once.
        trades = single_position(materialize(trades), max_horizon + 1)
    return trades.select(
        "symbol", "direction", F.col("ts").alias("signal_ts"), "entry_time", "exit_time", "entry", "exit",
        "quantity", "pnl", (F.col("pnl") / equity).alias("return_pct"), "reason", "cost", "risk_amount",
    )
