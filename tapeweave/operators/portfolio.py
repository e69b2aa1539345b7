"""Return correlations and portfolio limits over a trade ledger."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.arith import zero_null
from tapeweave.operators.indicators import add_indicators
from tapeweave.operators.scan import block_scan, range_blocks, time_block
from tapeweave.session import materialize

#: Symbols of a tile, moments added up at once, and returns of a tile from which on its moments are cut into slices.
TILE = 512
MOMENTS = 2048
GROUP = 4_000_000

_SUMS = ["n", "sa", "sb", "saa", "sbb", "sab"]


def simple_returns(bars: DataFrame, timeframe: str) -> DataFrame:
    """(symbol, ts, ret): each bar's change of close."""
    return add_indicators(bars, timeframe, ["ret_1"]).select("symbol", "ts", F.col("ret_1").alias("ret"))


def _packed(rows: pa.Table) -> pa.Table:
    """One row for all returns of a cell: its symbols in order, its moments in order, and both by number with the return."""

    def numbered(column: str) -> tuple[pa.Array, np.ndarray]:
        values = rows[column].combine_chunks()
        distinct = values.unique()
        distinct = distinct.take(pc.array_sort_indices(distinct))
        return distinct, pc.index_in(values, value_set=distinct).to_numpy().astype(np.int64)

    (names, who), (moments, when) = numbered("symbol"), numbered("ts")
    # Returns by moment; of a symbol's several at one moment the last counts.
    key = (when * len(names) + who)[::-1]
    key, last = np.unique(key, return_index=True)
    ret = rows["ret"].to_numpy()[::-1][last]
    short = lambda x, n: x.astype(np.min_scalar_type(n)).tobytes()
    return pa.table({
        "cell": rows["cell"][:1],
        "names": pa.array([names], pa.list_(names.type)), "moments": pa.array([moments], pa.list_(moments.type)),
        "who": pa.array([short(key % len(names), len(names))], pa.binary()),
        "at": pa.array([short(key // len(names), len(moments))], pa.binary()),
        "ret": pa.array([ret.astype(float).tobytes()], pa.binary()),
    })


@dataclass
class _Cell:
    """The packed returns of a tile in one slice."""

    number: int
    names: pa.Array
    moments: pa.Array
    who: np.ndarray
    at: np.ndarray
    ret: np.ndarray

    @staticmethod
    def of(row: pa.RecordBatch, side: str) -> _Cell:
        names, moments = row["names" + side].flatten(), row["moments" + side].flatten()
        read = lambda c, kind: np.frombuffer(row[c + side][0].as_buffer(), kind)
        return _Cell(
            row["cell" + side][0].as_py(), names, moments, read("who", np.min_scalar_type(len(names))),
            read("at", np.min_scalar_type(len(moments))), read("ret", float),
        )

    def dense(self, place: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is a return, and the return or 0, by common moments from ``low`` to ``high`` and symbol."""
        # Both sides' moments are in order, so those of a stretch are neighbours.
        a, b = np.searchsorted(self.at, np.searchsorted(place, [low, high]).astype(self.at.dtype))
        there, value = np.zeros((2, high - low, len(self.names)))
        row = place[self.at[a:b]] - low
        there[row, self.who[a:b]] = 1
        value[row, self.who[a:b]] = self.ret[a:b]
        return there, value


def _pair_sums(left: _Cell, right: _Cell) -> np.ndarray:
    """The sums of ``_SUMS`` over the common moments of every pair of the cells' symbols."""
    sums = np.zeros((6, len(left.names), len(right.names)))
    moments = pa.concat_arrays([left.moments, right.moments]).unique()
    moments = moments.take(pc.array_sort_indices(moments))
    places = [pc.index_in(t.moments, value_set=moments).to_numpy() for t in (left, right)]
    for low in range(0, len(moments), MOMENTS):
        high = min(low + MOMENTS, len(moments))
        (ma, xa), (mb, xb) = left.dense(places[0], low, high), right.dense(places[1], low, high)
        for total, (x, y) in zip(sums, ((ma, mb), (xa, mb), (ma, xb), (xa * xa, mb), (ma, xb * xb), (xa, xb))):
            total += x.T @ y
    return sums


def _correlation(s, sqrt, least_zero, no_zero):
    """Correlation from the sums, of columns or arrays."""
    var = lambda x, xx: least_zero(s["n"] * s[xx] - s[x] * s[x])
    return (s["n"] * s["sab"] - s["sa"] * s["sb"]) / no_zero(sqrt(var("sa", "saa")) * sqrt(var("sb", "sbb")))


def _cell_pairs(whole: bool, min_rows: int, least: float | None):
    """A row per pair of symbols of the two cells of every row: its sums, or its correlation if the moments are ``whole``."""

    def report(left: _Cell, right: _Cell) -> pa.RecordBatch:
        sums = _pair_sums(left, right)
        met = sums[0] >= (max(1, min_rows) if whole else 1)
        if left.number == right.number:
            met = np.triu(met, 1)
        a, b = np.nonzero(met)
        found = dict(zip(_SUMS, sums[:, a, b]))
        if whole:
            with np.errstate(all="ignore"):
                corr = _correlation(found, np.sqrt, lambda v: np.maximum(v, 0.0), lambda v: np.where(v == 0, np.nan, v))
            none = np.isnan(corr)
            if least is not None:
                kept = np.flatnonzero(~none & (np.abs(corr) >= least))
                a, b, corr, none, found = a[kept], b[kept], corr[kept], none[kept], {"n": found["n"][kept]}
            found = {"correlation": pa.array(corr, mask=none), "n": found["n"].astype(np.int64)}
        return pa.RecordBatch.from_pydict({"a": left.names.take(pa.array(a)), "b": right.names.take(pa.array(b))} | found)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield report(_Cell.of(row, ""), _Cell.of(row, "_b"))

    return meet


def return_correlations(
    returns: DataFrame, symbols: list[str] | None = None, min_rows: int = 1, tile: int = TILE, least: float | None = None, group: int = GROUP,
) -> DataFrame:
    """(symbol_a, symbol_b, correlation, n) of every pair ``a < b`` that shares ``min_rows`` moments.

    With ``least`` only pairs correlated as strongly, for or against, come out, which is what limits read; without it the result has
    a row per pair of symbols by nature. The returns never form pairs. The returns of ``tile`` symbols are packed into one row and
    stored, and each task adds up the pairs of the tiles in two parts of that table with matrix products. Parts are read from the
    stored table for every other part they meet, so no copy of a return is written and the disk grows with the returns alone; a
    task holds one part, at most what Spark puts into a partition of files. A pair's sums are whole where it is added up; only where
    few symbols have long histories are these cut into slices of some ``group`` returns a tile, whose sums per pair are shuffled.
    The returns are read twice here and not again later: pass a stored frame if they are costly, and drop it after the call.
    """
    # Neither null nor NaN nor infinite.
    valid = returns.filter(F.col("symbol").isNotNull() & (F.abs("ret") < float("inf")))
    if symbols is not None:
        valid = valid.filter(F.col("symbol").isin(symbols))
    # Both numbers only deal the work; an estimate will do for the symbols.
    rows, names = valid.agg(F.count(F.lit(1)), F.approx_count_distinct("symbol")).first()
    tiles = max(1, -(-names // tile))
    slices = max(1, -(-rows // (tiles * group)))
    cell = F.pmod(F.xxhash64("ts"), F.lit(slices)) * tiles + F.pmod(F.xxhash64("symbol"), F.lit(tiles))
    dealt = valid.select("symbol", "ts", F.col("ret").cast("double").alias("ret"), cell.alias("cell"))
    moment = dealt.schema["ts"].dataType.simpleString()
    packed = materialize(dealt.repartition(min(tiles * slices, 4096), "cell").groupBy("cell").applyInArrow(
        _packed, f"cell long, names array<string>, moments array<{moment}>, who binary, at binary, ret binary"
    ))
    # Cells of one slice meet, each pair once. A range and no equal keys, as these would bring a whole slice into one task.
    last = F.floor(F.col("cell") / tiles) * tiles + (tiles - 1)
    met = packed.join(packed.select(*[F.col(c).alias(f"{c}_b") for c in packed.columns]), F.col("cell_b").between(F.col("cell"), last))
    columns = "correlation double, n long" if slices == 1 else ", ".join(f"{c} double" for c in _SUMS)
    found = met.mapInArrow(_cell_pairs(slices == 1, min_rows, least), f"a string, b string, {columns}")
    if slices > 1:
        sums = found.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS]).filter(F.col("n") >= min_rows)
        corr = _correlation({c: F.col(c) for c in _SUMS}, F.sqrt, lambda v: F.greatest(v, F.lit(0.0)), zero_null)
        found = sums.withColumn("correlation", corr).withColumn("n", F.col("n").cast("long"))
        found = found if least is None else found.filter(F.abs("correlation") >= least)
    return found.select(F.least("a", "b").alias("symbol_a"), F.greatest("a", "b").alias("symbol_b"), "correlation", "n")


def correlation_lookup(pairs: DataFrame, correlations: DataFrame) -> DataFrame:
    """Correlation of each (symbol_a, symbol_b): 1 with itself, 0 where none is known."""
    both = correlations.select("symbol_a", "symbol_b", "correlation").unionByName(
        correlations.select(
            F.col("symbol_b").alias("symbol_a"), F.col("symbol_a").alias("symbol_b"), "correlation"
        )
    )
    known = F.coalesce("correlation", F.lit(0.0))
    return pairs.join(both, ["symbol_a", "symbol_b"], "left").withColumn(
        "correlation", F.when(F.col("symbol_a") == F.col("symbol_b"), 1.0).otherwise(known)
    )


def daily_pnl(ledger: DataFrame) -> DataFrame:
    """Ledger with ``day`` and ``day_pnl``, the result realised on the exit's day so far."""
    order = ["exit_time", "signal_ts", "symbol"]
    ranged = range_blocks(ledger.withColumn("day", F.to_date("exit_time")), order)
    return block_scan(ranged, ["day"], order, [F.col("_range")], {"day_pnl": ("sum", F.col("pnl"))}).drop("_range")


@dataclass(frozen=True)
class Limits:
    max_concurrent_positions: int = 5
    max_total_risk_pct: float = 0.06
    max_symbol_exposure_pct: float = 0.25
    max_daily_loss_pct: float = 0.03
    max_correlation: float = 0.8


# Money is added up in whole units of 1e-8, so that sums do not depend on the order of tasks.
UNIT = 10**8


def open_state(ledger: DataFrame) -> DataFrame:
    """Ledger with what was open or realised when each trade was signalled.

    ``open_count`` and ``open_risk``: other trades signalled before (ties by symbol) and not yet
    closed. ``realised_today``: results of trades closed that day so far. ``symbol_open``: whether
    the trade's own symbol was open. A sweep over opens and closes in time order: running sums, no
    joins between trades.
    """
    zero = F.lit(0).cast("long")
    risk, pnl = (F.round(F.col(c) * UNIT).cast("long") for c in ("risk_amount", "pnl"))
    held = block_scan(
        ledger, ["symbol"], ["signal_ts"], [time_block("signal_ts", 86400 * 30)],
        {"_until": ("max", F.col("exit_time"))}, inclusive=False,
    )
    row = F.struct(*ledger.columns, (F.col("_until") > F.col("signal_ts")).alias("_busy"))
    # Closes come before opens at the same moment.
    opens = held.select(
        F.col("signal_ts").alias("ts"), F.lit(1).alias("kind"), "symbol", "signal_ts",
        F.lit(1).alias("count"), risk.alias("risk"), zero.alias("gain"), row.alias("row"),
    )
    closes = ledger.select(
        F.col("exit_time").alias("ts"), F.lit(0).alias("kind"), "symbol", "signal_ts",
        F.lit(-1).alias("count"), (-risk).alias("risk"), pnl.alias("gain"),
        F.lit(None).cast(opens.schema["row"].dataType).alias("row"),
    )
    order = ["ts", "kind", "symbol", "signal_ts"]
    events = range_blocks(opens.unionByName(closes).withColumn("_day", F.to_date("ts")), order)
    swept = block_scan(
        events, ["_day"], order, [F.col("_range")],
        {"_count": ("sum", F.col("count")), "_risk": ("sum", F.col("risk")), "_gain": ("sum", F.col("gain"))},
        inclusive=False,
    )
    # What earlier days left open: one row per day.
    days = events.groupBy("_day").agg(F.sum("count").alias("_count0"), F.sum("risk").alias("_risk0"))
    past = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("_day", F.sum("_count0").over(past).alias("_count0"), F.sum("_risk0").over(past).alias("_risk0"))
    total = lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero)
    return swept.filter("kind = 1").join(carried, "_day").select(
        *[F.col("row")[c].alias(c) for c in ledger.columns],
        total("_count", "_count0").alias("open_count"),
        (total("_risk", "_risk0") / UNIT).alias("open_risk"),
        (F.coalesce("_gain", zero) / UNIT).alias("realised_today"),
        F.coalesce(F.col("row._busy"), F.lit(False)).alias("symbol_open"),
    )


def _correlated_open(ledger: DataFrame, correlations: DataFrame, limit: float) -> DataFrame:
    """(symbol, signal_ts, partner): the first-opened open trade of a strongly correlated symbol.

    Only strong pairs matter, so each trade asks about its own symbol's strong partners; each
    question is an as-of lookup in the partner's trades.
    """
    ways = [F.struct(F.col(f"symbol_{a}").alias("symbol"), F.col(f"symbol_{b}").alias("partner")) for a, b in ("ab", "ba")]
    # Stored: the scan below reads what depends on it more than once.
    partners = materialize(correlations.filter(F.abs("correlation") >= limit).select(F.inline(F.array(*ways))))
    trade = F.struct(F.col("signal_ts").alias("opened"), F.col("exit_time").alias("until"))
    held = ledger.select(
        F.col("symbol").alias("partner"), "signal_ts", F.col("symbol").alias("who"), trade.alias("trade"), F.lit(0).alias("ask")
    )
    asked = ledger.select("symbol", "signal_ts").join(partners, "symbol").select(
        "partner", "signal_ts", F.col("symbol").alias("who"),
        F.lit(None).cast(held.schema["trade"].dataType).alias("trade"), F.lit(1).alias("ask"),
    )
    seen = block_scan(
        held.unionByName(asked), ["partner"], ["signal_ts", "who", "ask"],
        [time_block("signal_ts", 86400), time_block("signal_ts", 3600)],
        {"last_trade": ("last", F.col("trade"))},
    )
    still = seen.filter((F.col("ask") == 1) & (F.col("last_trade.until") > F.col("signal_ts")))
    return still.groupBy(F.col("who").alias("symbol"), "signal_ts").agg(
        F.min(F.struct(F.col("last_trade.opened"), "partner")).alias("_first")
    ).select("symbol", "signal_ts", F.col("_first.partner").alias("partner"))


# The reasons as they are reported, in the order in which limits are tried.
BREACHES = {
    "symbol": "symbol already open",
    "count": "max concurrent positions",
    "loss": "daily loss limit reached",
    "exposure": "symbol exposure cap",
    "risk": "total risk budget",
    "correlated": "correlated with open ",
}


def limit_breaches(
    ledger: DataFrame, equity: float = 100_000.0, limits: Limits = Limits(), correlations: DataFrame | None = None
) -> DataFrame:
    """Ledger with ``reason``: the first limit each trade would break, or NULL.

    A report on a given ledger with one position per symbol; it does not change which trades exist.
    """
    state = open_state(ledger)
    notional = F.col("quantity") * F.col("entry")
    reason = (
        F.when(F.col("symbol_open"), BREACHES["symbol"])
        .when(F.col("open_count") >= limits.max_concurrent_positions, BREACHES["count"])
        .when(F.col("realised_today") <= -abs(limits.max_daily_loss_pct) * equity, BREACHES["loss"])
        .when(notional > limits.max_symbol_exposure_pct * equity + 1e-6, BREACHES["exposure"])
        .when(F.col("open_risk") + F.col("risk_amount") > limits.max_total_risk_pct * equity + 1e-6, BREACHES["risk"])
    )
    if correlations is not None:
        close = _correlated_open(ledger, correlations, limits.max_correlation)
        state = state.join(close, ["symbol", "signal_ts"], "left")
        reason = reason.when(F.col("partner").isNotNull(), F.concat(F.lit(BREACHES["correlated"]), F.col("partner")))
    return state.withColumn("breach", reason).drop("partner")


def breach_counts(breaches: DataFrame) -> DataFrame:
    """Trades per broken limit."""
    return breaches.filter(F.col("breach").isNotNull()).groupBy("breach").agg(F.count(F.lit(1)).alias("trades"))
