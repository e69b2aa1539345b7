"""Direction models on samples: trees, regression, their average, and walk-forward checks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.operators.bars import close_labeled, fill_missing_bars
from tapeweave.operators.evaluation import classification_report, fold_summary
from tapeweave.operators.indicators import FEATURE_COLUMNS
from tapeweave.operators.labels import from_class, label_settings
from tapeweave.operators.samples import (
    apply_scaler, block_edges, block_moments, build_samples, chronological_rank, class_weights, fold_blocks, model_columns,
    sample_timeframes, scale_columns, scaler_stats, with_fold_block,
)
from tapeweave.schemas import PRICE_COLUMNS
from tapeweave.session import materialize

N_CLASSES = 3


def _inputs(samples: DataFrame, features: list[str]) -> VectorAssembler:
    return VectorAssembler(
        inputCols=model_columns(features, sample_timeframes(samples, features[0])), outputCol="inputs"
    )


def _with_weights(samples: DataFrame) -> DataFrame:
    """Inverse-frequency weights. There is one weight per class, so they go in as constants: a join
    on the label would bring a class that holds most rows together in one task."""
    weight, rows = F.lit(1.0), class_weights(samples, n_classes=N_CLASSES).collect()
    if not sum(row["count"] for row in rows):
        raise ValueError("no series gave a labelled sample")
    for row in rows:
        weight = F.when(F.col("label") == row["label"], row["weight"]).otherwise(weight)
    return samples.withColumn("weight", weight)


def _fit(samples: DataFrame, features: list[str], estimator) -> PipelineModel:
    weighted = samples if "weight" in samples.columns else _with_weights(samples)
    return Pipeline(stages=[_inputs(samples, features), estimator]).fit(weighted)


def fit_trees(samples: DataFrame, features: list[str], trees: int = 50, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Class-balanced random forest on the flat window features."""
    return _fit(samples, features, RandomForestClassifier(
        featuresCol="inputs", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    ))


def fit_regression(samples: DataFrame, features: list[str], reg: float = 0.01, iterations: int = 30) -> PipelineModel:
    """Class-balanced multinomial regression on the flat window features."""
    return _fit(samples, features, LogisticRegression(
        featuresCol="inputs", labelCol="label", weightCol="weight", family="multinomial",
        regParam=reg, maxIter=iterations,
    ))


def top_class(probs):
    """Index of the largest probability, the first on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def _with_probs(model: PipelineModel, frame: DataFrame, out: str) -> DataFrame:
    """The frame with the model's probabilities; a class the training set lacked has probability 0."""
    raw = vector_to_array("probability")
    padded = F.slice(F.concat(raw, F.array_repeat(F.lit(0.0), N_CLASSES)), 1, N_CLASSES)
    return model.transform(frame).withColumn(out, padded).drop("inputs", "rawPrediction", "probability", "prediction")


def score(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """(symbol, ts, label, probs, pred). A class the training set lacked has probability 0."""
    out = _with_probs(model, samples, "probs").select("symbol", "ts", "label", "probs")
    return out.withColumn("pred", top_class(F.col("probs")))


def average_probs(first: DataFrame, second: DataFrame, weight: float = 0.5) -> DataFrame:
    """Weighted average of two models' scores, aligned by symbol and time."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must be between 0 and 1")
    other = second.select("symbol", "ts", F.col("probs").alias("_probs"))
    mixed = F.zip_with("probs", "_probs", lambda a, b: weight * a + (1.0 - weight) * b)
    return (
        first.join(other, ["symbol", "ts"]).withColumn("probs", mixed)
        .withColumn("pred", top_class(F.col("probs"))).drop("_probs")
    )


def to_signals(scored: DataFrame, horizon: int = 12, min_prob: float = 0.0) -> DataFrame:
    """(ts, symbol, direction, probability, horizon, probs), gated by probability."""
    return scored.select(
        "ts", "symbol", from_class(F.col("pred")).alias("direction"),
        F.array_max("probs").alias("probability"), F.lit(horizon).alias("horizon"), "probs",
    ).filter(F.col("probability") >= min_prob)


def fit_ensemble(samples: DataFrame, features: list[str], weight: float = 0.5, **options) -> dict:
    """Both members, fitted on the same samples; ``weight`` belongs to the regression."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must be between 0 and 1")
    stats = scaler_stats(samples, features)
    scaled = apply_scaler(samples, stats, features)
    return {
        "features": features, "weight": weight,
        "scaler": {r["feature"]: [r["mean"], r["std"]] for r in stats.collect()},
        "regression": fit_regression(scaled, features),
        "trees": fit_trees(scaled, features, **options),
    }


def _scaled(spark: SparkSession, ensemble: dict, samples: DataFrame) -> DataFrame:
    rows = [(k, m, s) for k, (m, s) in ensemble["scaler"].items()]
    stats = spark.createDataFrame(rows, "feature string, mean double, std double")
    return apply_scaler(samples, stats, ensemble["features"])


def member_probs(ensemble: dict, samples: DataFrame) -> DataFrame:
    """(symbol, ts, label, probs of the regression, probs of the trees): one pass over the samples, no join."""
    frame = _scaled(samples.sparkSession, ensemble, samples)
    for name in ("regression", "trees"):
        frame = _with_probs(ensemble[name], frame, name)
    return frame.select("symbol", "ts", "label", "regression", "trees")


def score_ensemble(ensemble: dict, samples: DataFrame) -> DataFrame:
    weight = ensemble["weight"]
    mixed = F.zip_with("regression", "trees", lambda a, b: weight * a + (1.0 - weight) * b)
    scored = member_probs(ensemble, samples).select("symbol", "ts", "label", mixed.alias("probs"))
    return scored.withColumn("pred", top_class(F.col("probs")))


def save_ensemble(spark: SparkSession, ensemble: dict, path: str) -> None:
    """Both members and one JSON row of features, scaler and weight."""
    for name in ("regression", "trees"):
        ensemble[name].write().overwrite().save(f"{path}/{name}")
    params = json.dumps({k: ensemble[k] for k in ("features", "weight", "scaler")})
    spark.createDataFrame([(params,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_ensemble(spark: SparkSession, path: str) -> dict:
    params = json.loads(spark.read.text(f"{path}/params").first()["value"])
    return params | {name: PipelineModel.load(f"{path}/{name}") for name in ("regression", "trees")}


def save_model(spark: SparkSession, model: PipelineModel, path: str, features: list[str], scaler: DataFrame | None = None) -> None:
    """One fitted model with what its inputs need: the features in order, and mean and deviation if they were scaled."""
    model.write().overwrite().save(f"{path}/model")
    stats = None if scaler is None else {r["feature"]: [r["mean"], r["std"]] for r in scaler.collect()}
    params = json.dumps({"features": features, "scaler": stats})
    spark.createDataFrame([(params,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_model(spark: SparkSession, path: str) -> dict:
    """``model``, ``features`` and ``scaler`` (feature to mean and deviation, or None) as they were saved."""
    return json.loads(spark.read.text(f"{path}/params").first()["value"]) | {"model": PipelineModel.load(f"{path}/model")}


def score_loaded(loaded: dict, samples: DataFrame) -> DataFrame:
    """Scores of a loaded model; samples are scaled as it was trained."""
    return score(loaded["model"], _scaled(samples.sparkSession, loaded, samples) if loaded["scaler"] else samples)


def _folded(samples: DataFrame, n_splits: int, expanding: bool) -> tuple[DataFrame, int, list[tuple[int, int]]]:
    """Stored samples with rank and fold block, the number of blocks, and the folds."""
    ranked = materialize(chronological_rank(samples))
    edges = block_edges(ranked.count(), n_splits)
    return materialize(with_fold_block(ranked, edges)), len(edges) - 1, fold_blocks(edges, expanding)


def walk_forward_reports(
    samples: DataFrame, features: list[str], n_splits: int = 4, expanding: bool = True, fit=None, **options
) -> DataFrame:
    """One row per fold: ``n_train`` and the classification report of its validation rows.

    Scaler, class weights and model see the fold's training rows only. Samples are ranked once; one aggregate gives
    the moments and class counts of every fold block, which add up to any fold's. ``fit`` (``fit_trees`` unless
    given) is called for all folds at once from threads; the folds' scores make one report.
    """
    folded, blocks, folds = _folded(samples, n_splits, expanding)
    if not folds:
        raise ValueError("too few samples for any fold")
    return _reports(_fold_scores(folded, blocks, folds, features, fit or fit_trees, options), folded, folds)


def _reports(scored: DataFrame, folded: DataFrame, folds: list[tuple[int, int]]) -> DataFrame:
    sizes = folded.groupBy("block").count().collect()  # a row per block
    n_train = {k: sum(r["count"] for r in sizes if low <= r["block"] < k) for k, low in folds}
    out = classification_report(scored, by=["fold"])
    chosen = F.coalesce(*[F.when(F.col("fold") == k, F.lit(n)) for k, n in n_train.items()]).cast("bigint")
    return out.select("fold", chosen.alias("n_train"), *[c for c in out.columns if c != "fold"])


def _fold_scores(folded: DataFrame, blocks: int, folds: list[tuple[int, int]], features: list[str], fit, options: dict, label: str = "label") -> DataFrame:
    """(fold, label, pred) of every fold's validation rows, by a model fitted on its training rows."""
    moments = block_moments(folded, features, blocks)
    counts = {(r["block"], r["label"]): r["n"] for r in folded.groupBy("block", F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}

    def one(fold: tuple[int, int]) -> DataFrame:
        k, low = fold
        stats = moments.stats(features, low, k)
        scaled = scale_columns(folded.filter(F.col("block") <= k), stats, features).withColumn("label", F.col(label))
        sizes = [sum(n for (b, c), n in counts.items() if low <= b < k and c == cls) for cls in range(N_CLASSES)]
        weight = F.element_at(F.array(*[F.lit(sum(sizes) / (N_CLASSES * max(1, n))) for n in sizes]), F.col("label") + 1)
        train = scaled.filter((F.col("block") >= low) & (F.col("block") < k)).withColumn("weight", weight)
        val = scaled.filter(F.col("block") == k)
        return score(fit(train, features, **options), val).select(F.lit(k).alias("fold"), "label", "pred")

    with ThreadPoolExecutor(max_workers=len(folds)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, folds))


def walk_forward_summary(samples: DataFrame, features: list[str], **options) -> DataFrame:
    return fold_summary(walk_forward_reports(samples, features, **options))


# --- nearest class means ---------------------------------------------------------------------


def _label_matrix(batch: pa.RecordBatch, labels: str) -> np.ndarray:
    column = batch.column(labels)
    return np.stack(column.to_numpy(zero_copy_only=False)) if pa.types.is_list(column.type) else column.to_numpy()[:, None]


def centroid_reports(
    samples: DataFrame, features: list[str], n_splits: int = 4, expanding: bool = True, labels: str = "label",
) -> DataFrame:
    """(setting, fold, n_train, report...): walk-forward reports of the nearest class mean, for many label settings at once.

    The model's input is every last and mean column in units of the feature's deviation over the fold's training
    windows; a sample gets the class whose training mean is nearest, of equal ones the first; classes without a
    training row are none's. ``labels`` is a column of classes or of arrays of them, one per setting. Two passes
    over the samples serve all folds and settings: sums per block and class, then counts of (label, prediction).
    """
    folded, blocks, folds = _folded(samples, n_splits, expanding)
    if not folds:
        raise ValueError("too few samples for any fold")
    return _centroid_reports(folded, blocks, folds, features, labels)


def _centroid_reports(folded: DataFrame, blocks: int, folds: list[tuple[int, int]], features: list[str], labels: str) -> DataFrame:
    columns = model_columns(features, sample_timeframes(folded, features[0]))
    settings = len(folded.first()[labels]) if isinstance(folded.schema[labels].dataType, T.ArrayType) else 1
    moments = block_moments(folded, features, blocks)
    narrow = folded.select("block", labels, *columns)
    cells = settings * N_CLASSES

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((blocks, cells), np.int64), np.zeros((blocks, cells, len(columns)))
        for batch in batches:
            x, y, block = matrix(batch), _label_matrix(batch, labels), batch.column("block").to_numpy()
            for s in range(settings):
                for c in range(N_CLASSES):
                    of = y[:, s] == c
                    n[:, s * N_CLASSES + c] += np.bincount(block[of], minlength=blocks)
                    np.add.at(total[:, s * N_CLASSES + c], block[of], x[of])
        at = np.flatnonzero(n.any(1))
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(np.repeat(at, cells)), "cell": pa.array(np.tile(np.arange(cells), at.size)),
            "n": pa.array(n[at].ravel()), "total": pa.array(list(total[at].reshape(-1, len(columns))), pa.list_(pa.float64())),
        })

    parts = narrow.mapInArrow(sums, "block bigint, cell bigint, n bigint, total array<double>")
    added = parts.select("block", "cell", "n", F.posexplode("total").alias("i", "x")).groupBy("block", "cell", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rows = added.groupBy("block", "cell").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("x"))
    n, total = np.zeros((blocks, cells)), np.zeros((blocks, cells, len(columns)))
    for r in rows.select("block", "cell", "n", F.col("x.x").alias("x")).collect():  # blocks x settings x classes
        n[r["block"], r["cell"]], total[r["block"], r["cell"]] = r["n"], r["x"]
    deviation = {k: moments.stats(features, low, k) for k, low in folds}
    # The columns go through all features for each timeframe and kind in turn.
    unit = {k: np.tile([deviation[k][c][1] for c in features], len(columns) // len(features)) for k, _ in folds}
    known = {k: n[low:k].sum(0) for k, low in folds}
    means = {k: total[low:k].sum(0) / np.maximum(known[k], 1)[:, None] / unit[k] for k, low in folds}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((blocks, settings, N_CLASSES, N_CLASSES), np.int64)
        for batch in batches:
            x, y, block = matrix(batch), _label_matrix(batch, labels), batch.column("block").to_numpy()
            for k, _ in folds:
                rows = np.flatnonzero(block == k)
                scaled = x[rows] / unit[k]
                for s in range(settings):
                    mine = slice(s * N_CLASSES, (s + 1) * N_CLASSES)
                    far = np.stack([((scaled - m) ** 2).sum(1) for m in means[k][mine]], axis=1)
                    far[:, known[k][mine] == 0] = np.inf
                    np.add.at(found[k, s], (y[rows, s], far.argmin(1)), 1)
        fold, setting, label, pred = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({
            "fold": fold.astype(np.int32), "setting": setting.astype(np.int32), "label": label.astype(np.int32), "pred": pred.astype(np.int32),
            "n": found[fold, setting, label, pred],
        })

    judged = narrow.mapInArrow(judge, "fold int, setting int, label int, pred int, n bigint")
    out = classification_report(judged, by=["setting", "fold"], count="n")
    sizes = {k: int(moments.n[low:k].sum()) for k, low in folds}
    chosen = F.coalesce(*[F.when(F.col("fold") == k, F.lit(m)) for k, m in sizes.items()]).cast("bigint")
    return out.select("setting", "fold", chosen.alias("n_train"), *[c for c in out.columns if c not in ("setting", "fold")])


# --- search ----------------------------------------------------------------------------------


def draw_trials(n_trials: int = 20, seed: int = 42) -> list[dict]:
    """Seeded random draws over the search ranges."""
    rng = np.random.default_rng(seed)
    return [
        {
            "take_profit_atr": float(rng.uniform(1.0, 3.0)),
            "stop_loss_atr": float(rng.uniform(0.5, 2.0)),
            "trees": int(rng.choice([20, 50, 100])),
            "depth": int(rng.integers(3, 8)),
        }
        for _ in range(n_trials)
    ]


def search_params(
    base: DataFrame, base_timeframe: str, context_timeframes: list[str], features: list[str] = FEATURE_COLUMNS,
    n_trials: int = 20, seed: int = 42, n_splits: int = 4, trials: list[dict] | None = None, min_samples: int = 50,
    keep: int = 4, keys: list[str] = ["symbol"], horizon: int = 12, atr_window: int = 14, **sample_options,
) -> DataFrame:
    """(trial, params..., n_samples, n_down, n_flat, n_up, fixed_score, rung, score) of every drawn setting, by successive halving.

    The samples' features are built once, and one scan ahead labels them under all settings. Rung 0 scores every
    setting with nearest class means, in two passes for all settings and folds. One in ``keep`` of them, the best,
    go on to rung 1, forests of a quarter of their trees, and one in ``keep`` of those to rung 2, whole forests.
    Scores are means of balanced accuracy over the walk-forward folds; ``score`` is that of the highest rung a
    setting reached, NULL at rung 0; equal scores go by the trial's number. With fewer than ``min_samples`` samples
    no setting has a score.
    """
    spark = base.sparkSession
    trials = trials or draw_trials(n_trials, seed)
    features_of = build_samples(
        base, base_timeframe, context_timeframes, features=features, require_label=False, horizon=horizon, keys=keys, atr_window=atr_window, **sample_options
    )
    closed = close_labeled(fill_missing_bars(base, base_timeframe, keys), base_timeframe).select(*keys, "ts", *PRICE_COLUMNS)
    settings = [(t["take_profit_atr"], t["stop_loss_atr"]) for t in trials]
    labelled = materialize(label_settings(closed, base_timeframe, settings, horizon, atr_window, keys))
    samples = materialize(features_of.drop("label", "ret").join(labelled, [*keys, "ts"]))
    per_class = samples.select(F.posexplode("labels").alias("trial", "label")).groupBy("trial").agg(
        *[F.count_if(F.col("label") == c).alias(f"c{c}") for c in range(N_CLASSES)]
    )
    counts = {r["trial"]: [r[f"c{c}"] for c in range(N_CLASSES)] for r in per_class.collect()}
    n = sum(counts.get(0, [0]))
    fixed, rung, best = {}, {}, {}
    if n >= min_samples:
        folded, blocks, folds = _folded(samples, n_splits, True)
        reports = _centroid_reports(folded, blocks, folds, features, "labels")
        fixed = {r["setting"]: r["balanced_accuracy_mean"] for r in fold_summary(reports, by=["setting"]).collect()}
        order = lambda scores: sorted(scores, key=lambda t: (-scores[t], t))
        left = order(fixed)
        for level, share in ((1, 4), (2, 1)):
            left = left[: max(1, len(left) // keep)]
            reached = {}
            for t in left:
                p, mine = trials[t], folded.withColumn("_label", F.get("labels", F.lit(t)))
                scored = _fold_scores(mine, blocks, folds, features, fit_trees, {"trees": max(1, p["trees"] // share), "depth": p["depth"], "seed": seed}, "_label")
                reached[t] = float(fold_summary(classification_report(scored, by=["fold"])).first()["balanced_accuracy_mean"])
            rung |= {t: level for t in left}
            best |= reached
            left = order(reached)
    rows = [
        (t, p["take_profit_atr"], p["stop_loss_atr"], p["trees"], p["depth"], n, *counts.get(t, [0] * N_CLASSES), fixed.get(t), rung.get(t, 0), best.get(t))
        for t, p in enumerate(trials)
    ]
    return spark.createDataFrame(
        rows, "trial int, take_profit_atr double, stop_loss_atr double, trees int, depth int, n_samples long, n_down long, n_flat long, n_up long,"
        " fixed_score double, rung int, score double"
    )


def best_trial(results: DataFrame) -> DataFrame:
    """The setting with the best score among those of the highest rung."""
    params = [c for c in results.columns if c != "score"]
    best = F.max_by(F.struct(*params), F.struct("rung", "score", -F.col("trial")))
    return results.filter("score IS NOT NULL").agg(best.alias("p"), F.max_by("score", F.struct("rung", "score")).alias("score")).select("p.*", "score")
