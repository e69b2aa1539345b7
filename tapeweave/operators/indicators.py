"""Technical indicators over close-labelled bars of many symbols.

``add_indicators`` numbers the bars, cuts each series into row blocks once, and computes every
requested column from windows that share this one shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.arith import safe_div, zero_null
from tapeweave.functions.timeframes import Timeframe
from tapeweave.operators.ewm import Ewm, ewm_means, halo_rows, span_alpha, sub_block_rows
from tapeweave.operators.patterns import PATTERN_COLUMNS, pattern_columns
from tapeweave.operators.scan import block_scan, time_block
from tapeweave.operators.series import BLOCK_ROWS, INDEX, Blocks, row_blocks, with_row_index
from tapeweave.schemas import PRICE_COLUMNS

# Names of the standard feature set, in output order.
INDICATOR_COLUMNS = [
    "ret_1", "log_ret_1", "ema_12", "ema_26", "sma_20", "rsi_14", "macd", "macd_signal", "macd_hist",
    "atr", "bb_mid", "bb_upper", "bb_lower", "bb_width", "stoch_k", "stoch_d", "adx", "plus_di",
    "minus_di", "vwap_dev", "obv_z", "close_pos", "range_atr",
]
FEATURE_COLUMNS = INDICATOR_COLUMNS + PATTERN_COLUMNS


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs of a feature frame: all columns but keys, prices and bookkeeping."""
    skip = {*PRICE_COLUMNS, "symbol", "timeframe", "ts", "imputed", INDEX}
    return [c for c in df.columns if c not in skip]


def counting_span(timeframe: str) -> int:
    """Seconds of one counting block: about as many bars as one row block."""
    return BLOCK_ROWS * Timeframe(timeframe).seconds


def blocked_bars(
    df: DataFrame, timeframe: str, keys: list[str], back: int, ahead: int, sub_rows: int = 2048,
    block_rows: int = BLOCK_ROWS,
) -> Blocks:
    indexed = df if INDEX in df.columns else with_row_index(df, keys, span_seconds=counting_span(timeframe))
    return row_blocks(indexed, keys, back=back, ahead=ahead, rows=block_rows, sub_rows=sub_rows)


def add_indicators(
    df: DataFrame,
    timeframe: str,
    wanted: list[str] = FEATURE_COLUMNS,
    keys: list[str] = ["symbol"],
    atr_window: int = 14,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Bars plus the wanted indicator and pattern columns (and the row index ``_i``)."""
    blocks = feature_blocks(df, timeframe, wanted, keys, atr_window, block_rows=block_rows)
    return blocks.own().select(*df.drop(INDEX).columns, INDEX, *wanted)


def feature_blocks(
    df: DataFrame,
    timeframe: str,
    wanted: list[str],
    keys: list[str] = ["symbol"],
    atr_window: int = 14,
    ahead: int = 0,
    extra_back: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> Blocks:
    """As ``add_indicators``, but still in blocks, with at least ``extra_back`` and ``ahead`` halo rows."""
    need = set(wanted)
    unknown = need - set(FEATURE_COLUMNS) - {"vwap", "true_range"}
    if unknown:
        raise ValueError(f"unknown indicators: {sorted(unknown)}")
    wilder = 1.0 / 14
    level1, level2 = [], []
    if need & {"ema_12", "macd", "macd_signal", "macd_hist"}:
        level1.append(Ewm("ema_12", "close", span_alpha(12), 12))
    if need & {"ema_26", "macd", "macd_signal", "macd_hist"}:
        level1.append(Ewm("ema_26", "close", span_alpha(26), 26))
    if "rsi_14" in need:
        level1 += [Ewm("_avg_gain", "_gain", wilder, 14, start=1), Ewm("_avg_loss", "_loss", wilder, 14, start=1)]
    if need & {"atr", "range_atr"}:
        level1.append(Ewm("atr", "true_range", 1.0 / atr_window, atr_window))
    if need & {"adx", "plus_di", "minus_di"}:
        level1.append(Ewm("_atr14", "true_range", wilder, 14))
        level1 += [Ewm("_plus", "_plus_dm", wilder, 14), Ewm("_minus", "_minus_dm", wilder, 14)]
    if need & {"macd_signal", "macd_hist"}:
        level2.append(Ewm("macd_signal", "macd", span_alpha(9), 9, start=25))
    if "adx" in need:
        level2.append(Ewm("adx", "_dx", wilder, 14, gaps=True))

    alphas = [m.alpha for m in level1 + level2]
    sub_rows = sub_block_rows(alphas)
    back = max([halo_rows(alphas, sub_rows) if alphas else 0, extra_back, _row_halo(need, timeframe)])
    blocks = blocked_bars(df, timeframe, keys, back, ahead, sub_rows, block_rows)

    blocks = _bar_inputs(blocks, need)
    blocks = ewm_means(blocks, level1)
    blocks = _derived(blocks, need)
    blocks = ewm_means(blocks, level2)
    return _final(blocks, need)


def _row_halo(need: set[str], timeframe: str) -> int:
    """Rows a window looks back, for the columns without a decaying mean."""
    rows = 2
    if need & {"sma_20", "bb_mid", "bb_upper", "bb_lower", "bb_width"}:
        rows = max(rows, 19)
    if need & {"stoch_k", "stoch_d"}:
        rows = max(rows, 15)
    if "obv_z" in need:
        rows = max(rows, 50)
    if need & {"vwap", "vwap_dev"}:
        # The session sum starts at midnight: one day of bars.
        rows = max(rows, -(-86400 // Timeframe(timeframe).seconds))
    return rows


def _full(value, rows: int, window):
    """A rolling aggregate that is NULL until its window holds ``rows`` values."""
    return F.when(F.count("close").over(window) >= rows, value)


def _bar_inputs(blocks: Blocks, need: set[str]) -> Blocks:
    order = blocks.window()
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    cols = {"_pc": F.lag("close").over(order)}
    if need & {"adx", "plus_di", "minus_di"}:
        cols |= {"_ph": F.lag("high").over(order), "_pl": F.lag("low").over(order)}
    last20, last14 = blocks.rows(-19, 0), blocks.rows(-13, 0)
    if need & {"sma_20", "bb_mid", "bb_upper", "bb_lower", "bb_width"}:
        cols["sma_20"] = _full(F.avg("close").over(last20), 20, last20)
        cols["_std20"] = _full(F.stddev_samp("close").over(last20), 20, last20)
    if need & {"stoch_k", "stoch_d"}:
        cols["_low14"] = _full(F.min("low").over(last14), 14, last14)
        cols["_high14"] = _full(F.max("high").over(last14), 14, last14)
    if need & set(PATTERN_COLUMNS):
        cols |= {"_po": F.lag("open").over(order), "_po2": F.lag("open", 2).over(order), "_pc2": F.lag("close", 2).over(order)}
    blocks = blocks.columns(cols)

    prior = F.col("_pc")
    cols = {"_delta": close - prior}
    if need & {"true_range", "atr", "range_atr", "adx", "plus_di", "minus_di"}:
        cols["true_range"] = F.greatest(high - low, F.abs(high - prior), F.abs(low - prior))
    if "rsi_14" in need:
        cols |= {"_gain": F.greatest(close - prior, F.lit(0.0)), "_loss": F.greatest(prior - close, F.lit(0.0))}
    if need & {"adx", "plus_di", "minus_di"}:
        up, down = high - F.col("_ph"), F.col("_pl") - low
        cols |= {
            "_plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    blocks = blocks.columns(cols)
    if "obv_z" in need:
        # The score does not depend on where the running sum starts, so the block's start will do.
        signed = F.coalesce(F.signum("_delta"), F.lit(0.0)) * F.col("volume")
        blocks = blocks.columns({"_obv": F.sum(signed).over(blocks.rows(Window.unboundedPreceding, 0))})
    return blocks


def _derived(blocks: Blocks, need: set[str]) -> Blocks:
    cols = {}
    if need & {"macd", "macd_signal", "macd_hist"}:
        cols["macd"] = F.col("ema_12") - F.col("ema_26")
    if need & {"adx", "plus_di", "minus_di"}:
        cols["plus_di"] = 100.0 * safe_div("_plus", "_atr14")
        cols["minus_di"] = 100.0 * safe_div("_minus", "_atr14")
    if need & {"stoch_k", "stoch_d"}:
        cols["stoch_k"] = 100.0 * (F.col("close") - F.col("_low14")) / zero_null(F.col("_high14") - F.col("_low14"))
    blocks = blocks.columns(cols)
    if "adx" in need:
        total = F.col("plus_di") + F.col("minus_di")
        blocks = blocks.columns({"_dx": 100.0 * F.abs(F.col("plus_di") - F.col("minus_di")) / zero_null(total)})
    return blocks


def _final(blocks: Blocks, need: set[str]) -> Blocks:
    close, prior = F.col("close"), F.col("_pc")
    windows = {}
    if "stoch_d" in need:
        last3 = blocks.rows(-2, 0)
        windows["stoch_d"] = F.when(F.count("stoch_k").over(last3) >= 3, F.avg("stoch_k").over(last3))
    if "obv_z" in need:
        last50 = blocks.rows(-49, 0)
        spread = zero_null(F.stddev_samp("_obv").over(last50))
        windows["obv_z"] = F.when(
            F.count("_obv").over(last50) >= 10, (F.col("_obv") - F.avg("_obv").over(last50)) / spread
        )
    blocks = blocks.columns(windows)
    if need & {"vwap", "vwap_dev"}:
        day = Window.partitionBy(*blocks.keys, "_blk", "_day").orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
        typical = (F.col("high") + F.col("low") + close) / 3.0
        blocks = blocks.columns({"_day": F.to_date("ts")})
        blocks = blocks.columns({
            "vwap": F.sum(typical * F.col("volume")).over(day) / zero_null(F.sum("volume").over(day))
        })

    cols = {}
    if "ret_1" in need:
        cols["ret_1"] = safe_div(close, prior) - 1.0
    if "log_ret_1" in need:
        cols["log_ret_1"] = F.ln(close) - F.ln(prior)
    if "rsi_14" in need:
        cols["rsi_14"] = 100.0 - 100.0 / (1.0 + safe_div("_avg_gain", "_avg_loss"))
    if "macd_hist" in need:
        cols["macd_hist"] = F.col("macd") - F.col("macd_signal")
    if need & {"bb_mid", "bb_upper", "bb_lower", "bb_width"}:
        mid, spread = F.col("sma_20"), 2.0 * F.col("_std20")
        cols |= {
            "bb_mid": mid, "bb_upper": mid + spread, "bb_lower": mid - spread,
            "bb_width": ((mid + spread) - (mid - spread)) / zero_null(mid),
        }
    if "vwap_dev" in need:
        cols["vwap_dev"] = (close - F.col("vwap")) / zero_null("close")
    span = zero_null(F.col("high") - F.col("low"))
    if "close_pos" in need:
        cols["close_pos"] = (close - F.col("low")) / span
    if "range_atr" in need:
        cols["range_atr"] = span / zero_null("atr")
    if need & set(PATTERN_COLUMNS):
        cols |= {k: v for k, v in pattern_columns().items() if k in need}
    return blocks.columns(cols)


def add_obv(df: DataFrame, timeframe: str, keys: list[str] = ["symbol"]) -> DataFrame:
    """On-balance volume: the running sum of volume signed by the close's direction."""
    blocks = blocked_bars(df, timeframe, keys, back=1, ahead=0)
    blocks = blocks.columns({"prior_close": F.lag("close").over(blocks.window())})
    signed = F.coalesce(F.signum(F.col("close") - F.col("prior_close")), F.lit(0.0)) * F.col("volume")
    rows = blocks.own().withColumn("signed_volume", signed).drop("prior_close")
    out = block_scan(rows, keys, ["ts"], [time_block("ts", counting_span(timeframe))], {"obv": ("sum", F.col("signed_volume"))})
    return out.drop("signed_volume", INDEX)


def add_patterns(df: DataFrame, timeframe: str, keys: list[str] = ["symbol"]) -> DataFrame:
    """Bars plus the seven candlestick flags."""
    return add_indicators(df, timeframe, PATTERN_COLUMNS, keys).drop(INDEX)
