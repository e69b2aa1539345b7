"""Blocked scans against brute force, with one series that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeweave.operators.asof import asof_join
from tapeweave.operators.scan import block_scan, time_block
from tapeweave.operators.series import INDEX, row_blocks, with_row_index


def skewed(n=900, seed=1):
    rng = np.random.default_rng(seed)
    symbol = rng.choice(["HOT", "a", "b"], n, p=[0.8, 0.1, 0.1])
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(90 * 1440, n, replace=False)), unit="min")
    value = rng.normal(size=n)
    value[rng.random(n) < 0.3] = np.nan
    return pd.DataFrame({"symbol": symbol, "ts": ts, "value": value})


@pytest.fixture(scope="module")
def frame(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, value double")
    return pdf, df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@pytest.mark.parametrize("levels", [[86400 * 7], [86400 * 20, 86400], [86400 * 30, 86400 * 3, 3600]])
@pytest.mark.parametrize("inclusive", [True, False])
def test_scan(frame, levels, inclusive):
    pdf, df = frame
    scans = {fn: (fn, F.col("value")) for fn in ("sum", "count", "max", "min", "last")}
    out = block_scan(df, ["symbol"], ["ts"], [time_block("ts", s) for s in levels], scans, inclusive)
    got = out.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = []
    for _, g in pdf.groupby("symbol"):
        g = g.sort_values("ts")
        r = pd.DataFrame({"sum": g.value.expanding().sum(), "count": g.value.notna().cumsum(), "max": g.value.cummax().ffill(),
                          "min": g.value.cummin().ffill(), "last": g.value.ffill()})
        r["sum"] = r["sum"].where(r["count"] > 0)
        want.append(r if inclusive else r.shift(1))
    want = pd.concat(want).reset_index(drop=True)
    for c in scans:
        w = want[c].fillna(0) if c == "count" else want[c]
        np.testing.assert_allclose(got[c].astype(float), w.astype(float), atol=1e-9, err_msg=c)


def test_scan_without_keys(frame):
    pdf, df = frame
    out = block_scan(df, [], ["ts", "symbol"], [time_block("ts", 86400 * 10), time_block("ts", 3600)], {"n": ("count", F.lit(1))})
    got = out.toPandas().sort_values(["ts", "symbol"])
    assert got["n"].tolist() == list(range(1, len(pdf) + 1))


def test_row_blocks_hold_every_window(frame):
    """Rolling windows over small blocks equal windows over the whole series."""
    pdf, df = frame
    indexed = with_row_index(df, span_seconds=86400 * 5)
    blocks = row_blocks(indexed, back=15, ahead=7, rows=32, sub_rows=16)
    out = blocks.columns({
        "back": F.count("value").over(blocks.rows(-15, 0)), "ahead": F.sum("value").over(blocks.rows(1, 7)),
    }).own().toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert len(out) == len(pdf)
    want = []
    for _, g in pdf.sort_values(["symbol", "ts"]).groupby("symbol"):
        g = g.reset_index(drop=True)
        want.append(pd.DataFrame({
            INDEX: range(len(g)),
            "back": [g.value[max(0, i - 15): i + 1].notna().sum() for i in range(len(g))],
            "ahead": [g.value[i + 1: i + 8].sum() if g.value[i + 1: i + 8].notna().any() else np.nan for i in range(len(g))],
        }))
    want = pd.concat(want).reset_index(drop=True)
    for c in want:
        np.testing.assert_allclose(out[c].astype(float), want[c].astype(float), atol=1e-9, err_msg=c)


def test_hot_series_spreads_over_tasks(spark, frame):
    _, df = frame
    blocks = row_blocks(with_row_index(df, span_seconds=86400 * 5), rows=32, sub_rows=16).df
    assert blocks.groupBy("symbol", "_blk").count().agg(F.max("count")).first()[0] == 32


def test_asof_matches_pandas(spark, frame):
    pdf, df = frame
    rng = np.random.default_rng(5)
    right = skewed(200, 9).drop_duplicates(["symbol", "ts"])
    exact = pdf.sample(40, random_state=2)[["symbol", "ts"]].assign(value=1.5)
    right = pd.concat([right.assign(value=rng.normal(size=len(right))), exact]).drop_duplicates(["symbol", "ts"], keep="last")
    rdf = spark.createDataFrame(right.rename(columns={"value": "x"}), "symbol string, ts timestamp_ntz, x double")
    other = rdf.filter("ts < '2024-02-01'").select("symbol", "ts", (F.col("x") * 2).alias("y"))
    got = asof_join(df, {"r": rdf, "o": other}, block_seconds=86400 * 4).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    merge = lambda r: pd.merge_asof(
        pdf.sort_values("ts"), r.sort_values("ts"), on="ts", by="symbol"
    ).sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = merge(right.rename(columns={"value": "x"}))
    np.testing.assert_allclose(got["x_r"].astype(float), want["x"], atol=0)
    early = right[right.ts < "2024-02-01"].rename(columns={"value": "y"})
    np.testing.assert_allclose(got["y_o"].astype(float), merge(early.assign(y=early.y * 2))["y"], atol=0)
    assert len(got) == len(pdf)


def test_asof_carries_over_blocks_without_right_rows(spark):
    """Hourly rows against two weekly ones: most days hold no right row at all, and none may lose its context."""
    hours = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=336, freq="h")})
    left = pd.concat([hours.assign(symbol=s) for s in ("a", "b")])
    weekly = pd.DataFrame({
        "symbol": ["a", "a", "b"], "ts": pd.to_datetime(["2024-01-01", "2024-01-08", "2024-01-03 05:00"], format="ISO8601"), "x": [1.0, 2.0, 3.0],
    })
    ldf = spark.createDataFrame(left[["symbol", "ts"]], "symbol string, ts timestamp_ntz")
    rdf = spark.createDataFrame(weekly, "symbol string, ts timestamp_ntz, x double")
    empty = rdf.filter("false").withColumnRenamed("x", "y")
    for seconds in (3600, 86400, 86400 * 30):
        got = asof_join(ldf, {"w": rdf, "none": empty}, block_seconds=seconds).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
        want = pd.merge_asof(left.sort_values("ts"), weekly.sort_values("ts"), on="ts", by="symbol").sort_values(["symbol", "ts"]).reset_index(drop=True)
        np.testing.assert_array_equal(got["x_w"].astype(float), want["x"])
        assert got["y_none"].isna().all() and len(got) == 672
