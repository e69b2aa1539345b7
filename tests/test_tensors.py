"""Window tensors against slices of pandas frames, as they are cut one sample at a time."""

import numpy as np
import pandas as pd
import pytest
from bar_rows import BAR, minute_rows
from pyspark.sql import functions as F

from tapeweave.operators import samples, tensors
from tapeweave.operators.series import INDEX, with_row_index

FEATURES = ["ret_1", "sma_20", "close_pos", "atr"]


@pytest.fixture(scope="module")
def base(spark):
    rows = minute_rows("A", days=2, per_day=150) + minute_rows("B", days=3, per_day=90, seed=3) + minute_rows("short", days=1, per_day=12, seed=5)
    return spark.createDataFrame(rows, BAR)


@pytest.mark.parametrize("window", [1, 3, 8])
def test_tensors_equal_slices_of_each_timeframe(base, window):
    frames = ["1m", "5m", "15m", "30m"]
    options = dict(window=window, horizon=4, features=FEATURES)
    got = tensors.build_tensors(base, "1m", frames, **options).toPandas().set_index(["symbol", "ts"])
    per_tf = samples.timeframe_features(base, frames, "1m", [*FEATURES])
    clean = {
        tf: {s: g.sort_values("ts") for s, g in samples.clean_features(f, FEATURES, tf).toPandas().groupby("symbol")} for tf, f in per_tf.items()
    }
    labels = samples.build_samples(base, "1m", ["1m"], features=FEATURES, window=1, horizon=4).toPandas().set_index(["symbol", "ts"])
    wanted = 0
    for (symbol, ts), row in labels.iterrows():
        windows = {}
        for tf in frames:
            bars = clean[tf][symbol]
            end = int(np.searchsorted(bars.ts.to_numpy(), np.datetime64(ts), side="right"))
            if end >= window:
                windows[tf] = bars[FEATURES].to_numpy(float)[end - window : end]
        if len(windows) < len(frames):
            assert (symbol, ts) not in got.index
            continue
        wanted += 1
        assert got.label[symbol, ts] == row.label
        for tf, w in windows.items():
            np.testing.assert_allclose(np.array([list(r) for r in got[f"window_{tf}"][symbol, ts]]), w, atol=1e-12)
    assert wanted == len(got) > 60


def test_bars_are_packed_twice_whatever_the_window(spark):
    """One hot series: no array holds more than two windows, and every bar lies in one or two of them."""
    n = 500
    rows = pd.DataFrame({"symbol": "HOT", "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "x": np.arange(n, dtype=float)})
    df = with_row_index(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double"))
    packed = tensors.pack_bars(df, ["x"], 64)
    sizes = [r[0] for r in packed.blocks.select(F.size("cells")).collect()]
    assert max(sizes) <= 127 and sum(sizes) < 2 * n and len(sizes) == -(-n // 64)
    pointed = packed.pointers.withColumnsRenamed({"block": "block_t", "offset": "offset_t"})
    got = tensors.fetch_windows(pointed, {"t": packed}).select("ts", F.transform("window_t", lambda r: r[0]).alias("w")).orderBy("ts").collect()
    assert [r["w"] for r in got] == [[float(x) for x in range(i - 63, i + 1)] for i in range(63, n)]


def test_no_sample_raises_at_building(base):
    with pytest.raises(ValueError, match="no series"):
        tensors.build_tensors(base, "1m", ["1m", "1d"], window=8, horizon=4, features=FEATURES)
    with pytest.raises(ValueError, match="no series"):
        samples.build_samples(base.filter("symbol = 'short'"), "1m", ["1m"], window=64, features=FEATURES)
    with pytest.raises(ValueError, match="at least one bar"):
        tensors.pack_bars(base.withColumn(INDEX, F.lit(0)), ["close"], 0)
