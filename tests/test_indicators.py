import numpy as np
import pandas as pd
import pytest
from bar_rows import BAR, minute_rows
from pyspark.sql import functions as F

from tapeweave.operators.bars import close_labeled, ticks_to_bars
from tapeweave.operators.ewm import Ewm, ewm_means
from tapeweave.operators.indicators import (
    FEATURE_COLUMNS, INDICATOR_COLUMNS, add_indicators, add_obv, add_patterns, feature_columns,
)
from tapeweave.operators.series import row_blocks, with_row_index
from tapeweave.plans import fixtures as fx


def wilder(s):
    return s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()


def expected(g):
    """The textbook formulas on one series, in pandas."""
    o, h, l, c, v = (g[k] for k in ("open", "high", "low", "close", "volume"))
    e = lambda s, n: s.ewm(span=n, adjust=False, min_periods=n).mean()
    out = {"ret_1": c / c.shift() - 1, "log_ret_1": np.log(c).diff(), "ema_12": e(c, 12), "ema_26": e(c, 26), "sma_20": c.rolling(20).mean()}
    d = c.diff()
    out["rsi_14"] = 100 - 100 / (1 + wilder(d.clip(lower=0)) / wilder(-d.clip(upper=0)).replace(0, np.nan))
    out["macd"] = out["ema_12"] - out["ema_26"]
    out["macd_signal"] = e(out["macd"], 9)
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    out["atr"] = wilder(tr)
    sd = c.rolling(20).std()
    out["bb_upper"], out["bb_width"] = out["sma_20"] + 2 * sd, 4 * sd / out["sma_20"]
    k = 100 * (c - l.rolling(14).min()) / (h.rolling(14).max() - l.rolling(14).min()).replace(0, np.nan)
    out["stoch_k"], out["stoch_d"] = k, k.rolling(3).mean()
    up, down = h.diff(), -l.diff()
    p = 100 * wilder(up.where((up > down) & (up > 0), 0.0)) / out["atr"]
    m = 100 * wilder(down.where((down > up) & (down > 0), 0.0)) / out["atr"]
    out["plus_di"], out["minus_di"] = p, m
    out["adx"] = wilder(100 * (p - m).abs() / (p + m).replace(0, np.nan))
    day = pd.to_datetime(g["ts"]).dt.normalize()
    vw = ((h + l + c) / 3 * v).groupby(day).cumsum() / v.groupby(day).cumsum().replace(0, np.nan)
    out["vwap_dev"] = (c - vw) / c
    ob = (np.sign(d).fillna(0) * v).cumsum()
    out["obv_z"] = (ob - ob.rolling(50, min_periods=10).mean()) / ob.rolling(50, min_periods=10).std().replace(0, np.nan)
    span = (h - l).replace(0, np.nan)
    out["close_pos"], out["range_atr"] = (c - l) / span, span / out["atr"].replace(0, np.nan)
    return pd.DataFrame(out)


def assert_matches(got, atol=1e-7):
    for _, g in got.groupby("symbol"):
        g = g.sort_values("ts").reset_index(drop=True)
        want = expected(g)
        for c in want:
            np.testing.assert_allclose(g[c].astype(float), want[c], atol=atol, rtol=1e-9, err_msg=c)


def test_all_columns_two_symbols(spark):
    df = spark.createDataFrame(minute_rows("A") + minute_rows("B", days=1, per_day=30, seed=4), BAR)
    out = add_indicators(df, "1m")
    assert feature_columns(out) == FEATURE_COLUMNS
    got = out.toPandas()
    assert len(got) == 390
    assert_matches(got)
    assert got["rsi_14"].dropna().between(0, 100).all() and (got["atr"].dropna() >= 0).all()
    late = got[(got.symbol == "A") & (got._i >= 60)]
    assert np.isfinite(late[[c for c in INDICATOR_COLUMNS if c not in ("stoch_k", "stoch_d")]].astype(float)).all().all()


def test_long_series_over_several_blocks(spark):
    """One series of some 39,000 bars, cut into blocks with halos."""
    ticks = fx.ticks(spark, "/root/testdata/sf0.1", F.lit("ALL"))
    bars = close_labeled(ticks_to_bars(ticks, "1m", label="start"), "1m")
    out = add_indicators(bars, "1m", block_rows=20480)
    got = out.toPandas()
    assert got["_i"].max() > 30000
    assert_matches(got, atol=1e-6)


def test_flat_stretch_keeps_ratios(spark):
    """RSI and ADX are ratios of two decaying means: a long flat stretch must not change them."""
    rows = minute_rows(days=1, per_day=200)
    last = rows[-1]
    from datetime import timedelta
    flat = [("AAA", last[1] + timedelta(minutes=i + 1), last[5], last[5], last[5], last[5], 0.0) for i in range(5000)]
    got = add_indicators(spark.createDataFrame(rows + flat, BAR), "1m", ["rsi_14", "adx", "plus_di", "atr"]).toPandas()
    got = got.sort_values("ts").reset_index(drop=True)
    o = got.rename(columns={})
    want = expected(o)
    np.testing.assert_allclose(o["rsi_14"].astype(float), want["rsi_14"], rtol=1e-6)
    np.testing.assert_allclose(o["adx"].astype(float), want["adx"], rtol=1e-6)


def test_means_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 2, 1500)
    x[rng.random(1500) < 0.4] = np.nan
    x[:7] = np.nan
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=1500, freq="1min"), "x": x})
    df = spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, x double").withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    blocks = row_blocks(with_row_index(df, span_seconds=6000), back=0, sub_rows=128, rows=2048)
    out = ewm_means(blocks, [Ewm("y", "x", 1 / 14, 14, gaps=True)]).own().orderBy("ts").toPandas()
    want = pd.Series(x).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    np.testing.assert_allclose(out["y"].astype(float), want, rtol=1e-10)


def test_no_lookahead(spark, minutes):
    """Cutting the future off must not change the past."""
    cut = minutes.filter("ts < '2024-06-04 15:00:00'")
    a = add_indicators(minutes, "1m").filter("ts < '2024-06-04 15:00:00'").orderBy("ts").toPandas()
    b = add_indicators(cut, "1m").orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)


def test_obv(spark):
    df = spark.createDataFrame(minute_rows("A") + minute_rows("B", seed=2), BAR)
    got = add_obv(df, "1m").toPandas()
    for _, g in got.groupby("symbol"):
        g = g.sort_values("ts")
        want = (np.sign(g.close.diff()).fillna(0) * g.volume).cumsum()
        np.testing.assert_allclose(g.obv, want, atol=1e-6)


def bars(*ohlc):
    from datetime import datetime, timedelta
    return [("A", datetime(2024, 6, 3) + timedelta(minutes=i), *map(float, b), 1.0) for i, b in enumerate(ohlc)]


@pytest.mark.parametrize("rows,column,value", [
    ([(10, 11, 9, 10.05)], "cdl_doji", 1),
    ([(10, 10, 10, 10)], "cdl_doji", 0),
    ([(10, 10.5, 8, 10.5)], "cdl_hammer", 1),
    ([(10, 12, 10, 10.5)], "cdl_inverted_hammer", 1),
    ([(10.5, 12, 10, 10)], "cdl_shooting_star", 1),
    ([(10, 12, 10, 12)], "cdl_marubozu", 1),
    ([(12, 12, 10, 10)], "cdl_marubozu", -1),
    ([(11, 11, 10, 10), (9.5, 12, 9, 11.5)], "cdl_engulfing", 1),
    ([(10, 11, 10, 11), (11.5, 12, 9, 9.5)], "cdl_engulfing", -1),
    ([(12, 12, 8, 8), (8, 8.5, 7.5, 8.2), (8.2, 12, 8, 11.5)], "cdl_morning_evening_star", 1),
    ([(8, 12, 8, 12), (12, 12.5, 11.5, 12.2), (12, 12, 8, 8.5)], "cdl_morning_evening_star", -1),
])
def test_patterns(spark, rows, column, value):
    got = add_patterns(spark.createDataFrame(bars(*rows), BAR), "1m").orderBy("ts").collect()
    assert got[-1][column] == value
