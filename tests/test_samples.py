import numpy as np
import pandas as pd
import pytest
from bar_rows import BAR, linear_rows, minute_rows
from pyspark.sql import functions as F

from tapeweave.operators import evaluation, samples
from tapeweave.operators.bars import fill_missing_bars
from tapeweave.operators.indicators import add_indicators
from tapeweave.operators.labels import from_class, to_class, triple_barrier_labels
from tapeweave.session import materialize


def test_rising_and_falling_labels(spark):
    df = spark.createDataFrame(linear_rows("UP", 100, 110) + linear_rows("DOWN", 110, 100, up=0.5, down=0.5), BAR)
    got = triple_barrier_labels(df, "5m", 12, 2.0, 1.0).toPandas()
    up, down = (got[got.symbol == s].sort_values("ts") for s in ("UP", "DOWN"))
    assert set(up.label.dropna()) == {1} and set(up.touched) == {"", "tp"}
    assert set(down.label.dropna()) == {-1}
    assert up.label.iloc[-12:].isna().all() and up.label.iloc[:13].isna().all() and up.label.iloc[13:-12].notna().all()


def brute_labels(g, horizon, tp, sl):
    tr = pd.concat([g.high - g.low, (g.high - g.close.shift()).abs(), (g.low - g.close.shift()).abs()], axis=1).max(axis=1)
    atr = tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    out = []
    for i in range(len(g)):
        a = atr[i]
        if not a > 0 or i + horizon >= len(g):
            out.append((np.nan, ""))
            continue
        up, low = g.close[i] + tp * a, g.close[i] - sl * a
        label, touched = 0, "vertical"
        for j in range(i + 1, i + horizon + 1):
            if g.low[j] <= low:
                label, touched = -1, "sl"
                break
            if g.high[j] >= up:
                label, touched = 1, "tp"
                break
        out.append((label, touched))
    return out


@pytest.mark.parametrize("horizon,tp,sl", [(12, 2.0, 1.0), (5, 1.0, 1.0), (30, 3.0, 2.5)])
def test_labels_match_brute_force(spark, horizon, tp, sl):
    df = spark.createDataFrame(minute_rows("A") + minute_rows("B", seed=7), BAR)
    got = triple_barrier_labels(df, "1m", horizon, tp, sl).toPandas()
    for _, g in got.groupby("symbol"):
        g = g.sort_values("ts").reset_index(drop=True)
        want = brute_labels(g, horizon, tp, sl)
        assert g.touched.tolist() == [w[1] for w in want]
        np.testing.assert_array_equal(g.label.astype(float), [w[0] for w in want])


def test_class_mapping(spark):
    df = spark.range(3).select((F.col("id") - 1).cast("int").alias("l"))
    got = df.select(to_class(F.col("l")).alias("c"), from_class(to_class(F.col("l"))).alias("b"), "l").collect()
    assert [r["c"] for r in got] == [0, 1, 2] and all(r["b"] == r["l"] for r in got)


def test_clean_features_across_blocks(spark):
    df = add_indicators(spark.createDataFrame(minute_rows(), BAR), "1m", ["ret_1"]).withColumn(
        "ret_1", F.when(F.col("_i") % 7 == 3, float("inf")).when(F.col("_i") % 5 == 0, None).otherwise(F.col("ret_1"))
    )
    before = df.orderBy("ts").toPandas()["ret_1"].replace([np.inf], np.nan).astype(float)
    got = samples.clean_features(df, ["ret_1"], "1m").orderBy("ts").toPandas()["ret_1"]
    np.testing.assert_allclose(got, before.ffill().fillna(0.0))


FEATURES = ["ret_1", "close_pos", "sma_20"]


@pytest.fixture(scope="module")
def built(spark):
    rows = minute_rows("A", days=4, per_day=300) + minute_rows("B", days=4, per_day=300, seed=3)
    base = spark.createDataFrame(rows, BAR)
    out = samples.build_samples(base, "1m", ["1m", "5m"], window=8, horizon=6, features=FEATURES)
    return base, materialize(out)


def test_samples_match_brute_force(built):
    """Each sample against windows sliced from the feature frames, closed bars only."""
    base, out = built
    filled = fill_missing_bars(base, "1m")
    got = out.toPandas()
    frames = {
        tf: add_indicators(samples.timeframe_bars(filled, tf, "1m"), tf, FEATURES).toPandas() for tf in ("1m", "5m")
    }
    picked = got.sample(60, random_state=0)
    for _, row in picked.iterrows():
        for tf, f in frames.items():
            g = f[f.symbol == row.symbol].sort_values("ts")
            clean = g[FEATURES].astype(float).replace([np.inf, -np.inf], np.nan).ffill().fillna(0.0)
            seen = clean[(g.ts <= row.ts).to_numpy()]
            assert len(seen) >= 8
            w = seen.iloc[-8:]
            for c in FEATURES:
                np.testing.assert_allclose(row[f"{c}_last_{tf}"], w[c].iloc[-1], atol=1e-9)
                np.testing.assert_allclose(row[f"{c}_mean_{tf}"], w[c].mean(), atol=1e-9)
    want = 0
    base_rows = frames["1m"]
    for s, g in base_rows.groupby("symbol"):
        g = g.sort_values("ts").reset_index(drop=True)
        five = frames["5m"][frames["5m"].symbol == s].ts.sort_values().to_numpy()
        labels = brute_labels(g, 6, 2.0, 1.0)
        want += sum(not np.isnan(labels[i][0]) and i >= 7 and (five <= g.ts[i].to_datetime64()).sum() >= 8 for i in range(len(g)))
    assert len(got) == want and set(got.label) <= {0, 1, 2}


def test_samples_for_scoring_keep_the_tail(built):
    base, out = built
    scoring = samples.build_samples(base, "1m", ["1m", "5m"], window=8, horizon=6, features=FEATURES, require_label=False)
    assert scoring.count() > out.count()
    assert scoring.agg(F.max("ts")).first()[0] == base.agg(F.max("ts") + F.expr("INTERVAL 1 MINUTE")).first()[0]


def test_scaler_counts_each_window(built):
    base, out = built
    stats = {r["feature"]: (r["mean"], r["std"]) for r in samples.scaler_stats(out, FEATURES).collect()}
    arrays = {}
    filled = fill_missing_bars(base, "1m")
    for tf in ("1m", "5m"):
        f = samples.clean_features(add_indicators(samples.timeframe_bars(filled, tf, "1m"), tf, FEATURES), FEATURES, tf)
        arrays[tf] = samples.window_arrays(f, FEATURES, 8).toPandas()
    values = []
    for _, row in out.select("symbol", "ts").toPandas().iterrows():
        for a in arrays.values():
            near = a[(a.symbol == row.symbol) & (a.ts <= row.ts)].sort_values("ts").iloc[-1]
            values.append(np.array([list(x) for x in near["window"]]))
    flat = np.concatenate(values)
    for i, c in enumerate(FEATURES):
        np.testing.assert_allclose(stats[c], (flat[:, i].mean(), flat[:, i].std()), rtol=1e-8)
    scaled = samples.apply_scaler(out, samples.scaler_stats(out, FEATURES), FEATURES).toPandas()
    raw = out.toPandas()
    np.testing.assert_allclose(
        scaled.sort_values(["symbol", "ts"])["sma_20_last_5m"],
        ((raw["sma_20_last_5m"] - stats["sma_20"][0]) / stats["sma_20"][1])[raw.sort_values(["symbol", "ts"]).index],
    )


def ranked_frame(spark, n=103):
    rows = [(f"s{i % 3}", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=37 * (i // 3))) for i in range(n)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts"]), "symbol string, ts timestamp_ntz")


def test_temporal_split(spark):
    got = samples.temporal_split(ranked_frame(spark), 0.2).orderBy("rank").toPandas()
    assert got["rank"].tolist() == list(range(103))
    assert got["role"].tolist() == ["train"] * 82 + ["val"] * 21
    assert got[["ts", "symbol"]].equals(got.sort_values(["ts", "symbol"])[["ts", "symbol"]])


@pytest.mark.parametrize("expanding", [True, False])
def test_walk_forward(spark, expanding):
    got = samples.walk_forward_folds(ranked_frame(spark), 4, expanding).toPandas()
    bounds = np.linspace(0, 103, 6, dtype=int)
    for k in range(1, 5):
        train = sorted(got[(got.fold == k) & (got.role == "train")]["rank"])
        val = sorted(got[(got.fold == k) & (got.role == "val")]["rank"])
        assert train == list(range(0 if expanding else bounds[k - 1], bounds[k]))
        assert val == list(range(bounds[k], bounds[k + 1]))
    with pytest.raises(ValueError):
        samples.walk_forward_folds(ranked_frame(spark), 0)


def test_walk_forward_drops_empty_folds(spark):
    got = samples.walk_forward_folds(ranked_frame(spark, 3), 5).select("fold").distinct().count()
    bounds = np.linspace(0, 3, 7, dtype=int)
    assert got == sum(bounds[i] > 0 and bounds[i + 1] > bounds[i] for i in range(1, 6))


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "label int, pred int")


def test_confusion_and_perfect_report(spark):
    df = predictions(spark, [(0, 0), (1, 1), (2, 2), (0, 1), (2, 0), (1, 1), (5, 1), (1, 3)])
    got = {(r["label"], r["pred"]): r["count"] for r in evaluation.confusion_matrix(df).collect()}
    assert len(got) == 9 and got[0, 1] == 1 and got[1, 1] == 2 and got[2, 1] == 0 and sum(got.values()) == 6
    perfect = evaluation.classification_report(predictions(spark, [(0, 0), (1, 1), (2, 2)])).first()
    assert perfect["accuracy"] == perfect["balanced_accuracy"] == perfect["macro_f1"] == 1.0


def test_imbalance_lowers_balanced_accuracy(spark):
    df = predictions(spark, [(0, 0)] * 90 + [(1, 0)] * 10)
    got = evaluation.classification_report(df, n_classes=2).first()
    assert got["accuracy"] == pytest.approx(0.9) and got["balanced_accuracy"] == pytest.approx(0.5)


def test_fold_summary(spark):
    df = spark.createDataFrame([(0.5, 0.4, 0.6), (0.7, 0.2, 0.6)], "balanced_accuracy double, macro_f1 double, accuracy double")
    got = evaluation.fold_summary(df).first()
    assert got["n_folds"] == 2 and got["balanced_accuracy_mean"] == pytest.approx(0.6)
    assert got["balanced_accuracy_std"] == pytest.approx(0.1) and got["accuracy_std"] == 0


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(2,)] * 2, "label int")
    got = {r["label"]: r["weight"] for r in samples.class_weights(df).collect()}
    assert got == pytest.approx({0: 8 / 18, 1: 8 / 3, 2: 8 / 6})


def test_one_moment_is_ranked_by_many_tasks(spark):
    """All rows at one time: the order within it is split all the same."""
    from tapeweave.operators.scan import range_blocks

    df = spark.range(20_000).selectExpr("concat('S', id) as symbol", "timestamp_ntz'2024-06-03 00:00:00' as ts")
    # Small ranges share a task unless told otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in range_blocks(df, ["ts", "symbol"]).groupBy("_range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 20_000
    got = samples.chronological_rank(df).orderBy("rank").limit(3).collect()
    assert [(r["symbol"], r["rank"]) for r in got] == [("S0", 0), ("S1", 1), ("S10", 2)]
