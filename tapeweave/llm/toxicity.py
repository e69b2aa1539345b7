"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learned with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.llm.arrowtext import LOWER, grown, mix, owners, slices, text_bytes, word_hashes, word_spans

#: ASCII bytes other than letters and digits end a word here, so marks around a word don't hide it.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = True
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def features(texts: pa.Array, bits: int, skip: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word, every pair of neighbours, and every pair with up to ``skip`` words between."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, BREAKS)
    h, owner = word_hashes(data, starts, ends), owners(bounds)
    shift = np.uint64(64 - bits)
    hashes, texts_of = [h], [owner]
    for gap in range(1, skip + 2):
        if h.size <= gap:
            break
        same = owner[gap:] == owner[:-gap]
        # Pairs with words between are one feature whatever their distance.
        salt = np.uint64(0x2545F4914F6CDD1D if gap == 1 else 0x9FB21C651E98DF25)
        hashes.append(mix(h[:-gap] * salt + h[gap:])[same])
        texts_of.append(owner[:-gap][same])
    return np.concatenate(texts_of), (np.concatenate(hashes) >> shift).astype(np.int64)


@dataclass
class ToxicityModel:
    """Sparse weights as a dense table of float32: ``2**bits`` entries, the proven size of what is sent out."""

    weights: np.ndarray
    bias: float
    bits: int

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of the positive label; a feature counts once per text."""
        of, bucket = features(texts, self.bits)
        live = self.weights[bucket] != 0
        pair = np.unique((of[live] << self.bits) + bucket[live])
        total = np.bincount(pair >> self.bits, self.weights[pair & ((1 << self.bits) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def ftrl(
    rows: list[tuple[np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, weight_of: tuple[float, float],
) -> tuple[np.ndarray, float]:
    """Online FTRL-proximal over rows of (distinct buckets, label) in the given order; the bias has no penalty.

    ``weight_of`` weighs the rows of label 0 and of label 1.
    """
    n, z, bias_n, bias = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0

    def weight(z_i, n_i):
        return np.where(np.abs(z_i) <= l1, 0.0, -(z_i - np.sign(z_i) * l1) / ((beta + np.sqrt(n_i)) / alpha + l2))

    for _ in range(epochs):
        for buckets, label in rows:
            z_i, n_i = z[buckets], n[buckets]
            w = weight(z_i, n_i)
            g = 1 / (1 + np.exp(-min(35.0, max(-35.0, w.sum() + bias)))) - label
            g *= weight_of[label]
            sigma = (np.sqrt(n_i + g * g) - np.sqrt(n_i)) / alpha
            z[buckets], n[buckets] = z_i + g - sigma * w, n_i + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    return weight(z, n).astype(np.float32), float(bias)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    bits: int = 20, per_class: int = 4000, most: int = 1 << 14, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0,
) -> ToxicityModel:
    """Weights learned from a sample of about ``per_class`` labelled documents of each class.

    A rarer positive class weighs up to four times as much. The sample takes the labelled rows of ``train`` whose
    id hashes below a bound, and of each text at most ``most`` features, those of least number; as it has a proven
    size, its ids go to the documents as a broadcast and its features to one task, which learns. No text is
    shuffled, and the driver gets the weights alone. Rows with a null id, text or label teach nothing; an id with
    both labels counts as positive; repeated documents teach each time. Without a row of each class the model
    scores all texts alike. The order of learning follows a hash of the id, so the result does not depend on the
    partitions.
    """
    labelled = labels.filter(train & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("_label")
    )
    sizes = dict(labelled.groupBy("_label").count().collect())
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(1 << bits, np.float32), -4.0, bits)
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30))
    bound = F.when(F.col("_label") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0])) * float(1 << 30)
    # Learned in the order of another hash: by the draw, the class with the smaller share would come first.
    sample = labelled.withColumn("_draw", draw).filter(F.col("_draw") < bound).withColumn("_draw", F.xxhash64("_id", F.lit(13)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).filter("text IS NOT NULL")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                of, bucket = features(texts.slice(a, b - a), bits)
                pair = np.unique((of << bits) + bucket)
                cuts = np.searchsorted(pair >> bits, np.arange(b - a + 1))
                if (np.diff(cuts) > most).any():
                    pair = pair[np.arange(pair.size) - cuts[pair >> bits] < most]
                    cuts = np.searchsorted(pair >> bits, np.arange(b - a + 1))
                found = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((pair & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_draw").slice(a, b - a), batch.column("_id").slice(a, b - a), batch.column("_label").slice(a, b - a), found],
                    ["draw", "id", "label", "buckets"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            buckets = batch.column("buckets")
            cuts, flat = buckets.offsets.to_numpy(), buckets.values.to_numpy()
            keys = zip(batch.column("draw").to_pylist(), batch.column("id").to_pylist(), batch.column("label").to_pylist())
            examples += [(*key, flat[a:b].copy()) for key, a, b in zip(keys, cuts[:-1], cuts[1:])]
        if not examples:
            return
        examples.sort(key=lambda e: (e[0], e[1], e[3].size, e[3].tobytes()))
        positive = sum(e[2] for e in examples)
        balance = (1.0, min(4.0, max(1.0, (len(examples) - positive) / max(1, positive))))
        weights, bias = ftrl([(e[3], e[2]) for e in examples], bits, epochs, alpha, beta, l1, l2, balance)
        live = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([bias]), pa.array([live.astype(np.int32).tobytes()], pa.binary()), pa.array([weights[live].tobytes()], pa.binary())], ["bias", "live", "weights"]
        )

    wanted = texts.join(F.broadcast(sample), "_id").select("_draw", F.col("_id").cast("string").alias("_id"), "_label", "text")
    drawn = wanted.mapInArrow(rows, "draw bigint, id string, label int, buckets array<int>").repartition(1)
    model = drawn.mapInArrow(learn, "bias double, live binary, weights binary").first()
    weights = np.zeros(1 << bits, np.float32)
    if model is None:
        return ToxicityModel(weights, -4.0, bits)
    weights[np.frombuffer(model["live"], np.int32)] = np.frombuffer(model["weights"], np.float32)
    return ToxicityModel(weights, model["bias"], bits)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability that the whole text is toxic to every row.

    Null and empty texts get the model's bias alone; equal texts get equal scores; repeated rows stay; an empty
    table gives no row. A column named like the added one is replaced, all others are kept. Texts are read in
    slices of bounded size.
    """
    kept = docs.drop(out)
    names, schema = kept.columns, grown(kept.schema, **{out: "double"})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text))
            scores = [sent.value.score(texts.slice(a, b - a)) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], [*names, out]
            )

    return kept.mapInArrow(score, schema)
