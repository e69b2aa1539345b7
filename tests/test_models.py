import numpy as np
import pytest
from bar_rows import BAR, minute_rows
from pyspark.sql import functions as F

from tapeweave.operators import labels, models, samples
from tapeweave.session import materialize

FEATURES = ["ret_1", "close_pos"]


@pytest.fixture(scope="module")
def data(spark):
    rows = minute_rows("A", days=2, per_day=200) + minute_rows("B", days=2, per_day=200, seed=3)
    base = spark.createDataFrame(rows, BAR)
    built = samples.build_samples(base, "1m", ["1m", "5m"], window=8, horizon=6, features=FEATURES)
    return base, materialize(samples.temporal_split(built))


def test_ensemble_is_the_average_and_survives_saving(spark, data, tmp_path):
    _, s = data
    train, val = s.filter("role = 'train'"), s.filter("role = 'val'")
    both = models.fit_ensemble(train, FEATURES, 0.3, trees=5, depth=3)
    got = models.score_ensemble(both, val).orderBy("symbol", "ts").toPandas()
    scaled = samples.apply_scaler(val, spark.createDataFrame(
        [(k, *v) for k, v in both["scaler"].items()], "feature string, mean double, std double"), FEATURES)
    parts = [np.stack(models.score(both[m], scaled).orderBy("symbol", "ts").toPandas().probs) for m in ("regression", "trees")]
    probs = np.stack(got.probs)
    np.testing.assert_allclose(probs, 0.3 * parts[0] + 0.7 * parts[1], atol=1e-9)
    np.testing.assert_allclose(probs.sum(axis=1), 1.0, atol=1e-9)
    assert got.pred.tolist() == probs.argmax(axis=1).tolist()
    models.save_ensemble(spark, both, str(tmp_path / "m"))
    again = models.score_ensemble(models.load_ensemble(spark, str(tmp_path / "m")), val).orderBy("symbol", "ts").toPandas()
    np.testing.assert_allclose(np.stack(again.probs), probs, atol=1e-9)
    signals = models.to_signals(models.score_ensemble(both, val), 6, 0.5).collect()
    assert all(r["probability"] >= 0.5 and r["direction"] in (-1, 0, 1) and r["horizon"] == 6 for r in signals)
    with pytest.raises(ValueError):
        models.fit_ensemble(train, FEATURES, 1.5)


def test_training_sees_only_the_past(data):
    _, s = data
    assert s.filter("role = 'train'").agg(F.max("ts")).first()[0] <= s.filter("role = 'val'").agg(F.min("ts")).first()[0]


def test_walk_forward_reports(data):
    _, s = data
    reports = models.walk_forward_reports(s.drop("role", "rank"), FEATURES, n_splits=2, trees=3, depth=2).collect()
    assert [r["fold"] for r in reports] == [1, 2]
    assert all(0 <= r["balanced_accuracy"] <= 1 and r["n"] > 0 for r in reports)


def test_search(data):
    base, _ = data
    trials = models.draw_trials(2, seed=1)
    assert trials == models.draw_trials(2, seed=1) and all(1 <= t["take_profit_atr"] <= 3 for t in trials)
    few = base.filter("symbol = 'A' and ts < '2024-06-03 15:30:00'")
    out = models.search_params(few, "1m", ["1m"], FEATURES, trials=trials[:1], window=8, horizon=60)
    row = out.first()
    assert row["score"] is None and row["n_samples"] < 50  # too few to say
    out = models.search_params(base, "1m", ["1m"], FEATURES, trials=[t | {"trees": 3, "depth": 2} for t in trials], n_splits=2, window=8, horizon=6)
    best = models.best_trial(out).first()
    rows = out.collect()
    assert [r["rung"] for r in rows].count(2) == 1 and best["trial"] == next(r["trial"] for r in rows if r["rung"] == 2) and best["score"] > 0
    assert max(rows, key=lambda r: (r["fixed_score"], -r["trial"]))["rung"] > 0 and all(r["score"] is None for r in rows if not r["rung"])
    assert all(r["n_down"] + r["n_flat"] + r["n_up"] == r["n_samples"] for r in rows)


def test_saved_model_scores_alike(spark, data, tmp_path):
    _, s = data
    stats = samples.scaler_stats(s, FEATURES)
    model = models.fit_trees(samples.apply_scaler(s, stats, FEATURES), FEATURES, trees=3, depth=2)
    models.save_model(spark, model, str(tmp_path / "m"), FEATURES, stats)
    loaded = models.load_model(spark, str(tmp_path / "m"))
    assert loaded["features"] == FEATURES
    key = lambda df: sorted((r["symbol"], r["ts"], r["pred"]) for r in df.collect())
    assert key(models.score_loaded(loaded, s)) == key(models.score(model, samples.apply_scaler(s, stats, FEATURES)))
    with pytest.raises(ValueError, match="no series"):
        models.fit_trees(s.filter("false"), FEATURES)


def test_many_settings_are_labelled_as_each_alone(spark):
    bars = spark.createDataFrame(minute_rows("A", days=2, per_day=150) + minute_rows("B", days=1, per_day=40, seed=4), BAR)
    settings = [(2.0, 1.0), (1.0, 0.5), (0.7, 1.9)]
    got = {(r["symbol"], r["ts"]): r["labels"] for r in labels.label_settings(bars, "1m", settings, horizon=9).collect()}
    for k, (take, stop) in enumerate(settings):
        alone = labels.triple_barrier_labels(bars, "1m", 9, take, stop).filter("label IS NOT NULL").collect()
        assert {(r["symbol"], r["ts"]): int(r["label"]) + 1 for r in alone} == {at: x[k] for at, x in got.items()}
    assert len({tuple(x) for x in got.values()}) > 5
