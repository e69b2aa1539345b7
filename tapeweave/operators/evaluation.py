"""Classification measures from predicted classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.arith import zero_null

# Names of the classes 0, 1, 2.
CLASS_NAMES = ["down", "flat", "up"]
FOLD_METRICS = ["balanced_accuracy", "macro_f1", "accuracy"]


def _in_range(label: str, pred: str, k: int):
    return F.col(label).between(0, k - 1) & F.col(pred).between(0, k - 1)


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred", n_classes: int = 3) -> DataFrame:
    """(label, pred, count) for every pair of classes, zeros included; other values are ignored."""
    cells = [(t, p) for t in range(n_classes) for p in range(n_classes)]
    row = df.agg(*[F.count_if((F.col(label) == t) & (F.col(pred) == p)).alias(f"n{t}{p}") for t, p in cells])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("label"), F.lit(p).alias("pred"), F.col(f"n{t}{p}").alias("count")) for t, p in cells
    ])))


def classification_report(
    df: DataFrame, label: str = "label", pred: str = "pred", n_classes: int = 3, by: list[str] = [], count: str | None = None,
) -> DataFrame:
    """One row per group: size, accuracy, balanced accuracy, macro F1 and per-class measures.

    ``count`` names a column of how many samples a row stands for; without it every row is one.
    """
    y, p = F.col(label), F.col(pred)
    valid = _in_range(label, pred, n_classes)
    each = F.lit(1).cast("bigint") if count is None else F.col(count)
    total = lambda test: F.coalesce(F.sum(F.when(test, each)), F.lit(0).cast("bigint"))
    counts = [total(F.lit(True)).alias("_n"), total(y == p).alias("_right")]
    for k in range(n_classes):
        counts += [
            total(valid & (y == k) & (p == k)).alias(f"_tp{k}"),
            total(valid & (p == k)).alias(f"_pred{k}"),
            total(valid & (y == k)).alias(f"_true{k}"),
        ]
    totals = df.groupBy(*by).agg(*counts)
    ratio = lambda a, b: F.coalesce(F.col(a) / zero_null(F.col(b).cast("double")), F.lit(0.0))
    rates = {}
    for k in range(n_classes):
        name = CLASS_NAMES[k] if k < len(CLASS_NAMES) else str(k)
        rates[f"precision_{name}"] = ratio(f"_tp{k}", f"_pred{k}")
        rates[f"recall_{name}"] = ratio(f"_tp{k}", f"_true{k}")
    rated = totals.withColumns(rates)
    names = [c[len("recall_"):] for c in rates if c.startswith("recall_")]
    f1 = {}
    for name in names:
        pr, re = F.col(f"precision_{name}"), F.col(f"recall_{name}")
        f1[f"f1_{name}"] = F.coalesce(2 * pr * re / zero_null(pr + re), F.lit(0.0))
    rated = rated.withColumns(f1)
    mean = lambda kind: sum((F.col(f"{kind}_{n}") for n in names[1:]), F.col(f"{kind}_{names[0]}")) / n_classes
    return rated.select(
        *by,
        F.col("_n").cast("double").alias("n"),
        ratio("_right", "_n").alias("accuracy"),
        mean("recall").alias("balanced_accuracy"),
        mean("f1").alias("macro_f1"),
        *[f"{kind}_{n}" for n in names for kind in ("precision", "recall", "f1")],
    )


def fold_summary(reports: DataFrame, metrics: list[str] = FOLD_METRICS, by: list[str] = []) -> DataFrame:
    """Mean and population deviation of the measures over folds."""
    stats = []
    for m in metrics:
        stats += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return reports.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n_folds"), *stats)
