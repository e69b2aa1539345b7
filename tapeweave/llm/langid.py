"""Language identification by nearest TF-IDF centroid over hashed n-grams of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeweave.llm.arrowtext import grown, slices, text_bytes
from tapeweave.session import materialize

#: The answer for texts without letters and for texts that no centroid is near.
UNKNOWN = "und"


def ngram_counts(texts: pa.Array, dims: int) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams, a row per text.

    Lower case; every run of ASCII bytes other than letters counts as one space, so digits, marks and
    layout add little.
    """
    data, offsets = text_bytes(pc.utf8_lower(texts))
    plain = np.arange(256, dtype=np.uint32)
    plain[:128] = 32
    plain[97:123] = np.arange(97, 123)
    symbols = plain[data]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    if symbols.size:
        keep = np.ones(symbols.size, bool)
        keep[1:] = (symbols[1:] != 32) | (symbols[:-1] != 32) | (owner[1:] != owner[:-1])
        symbols, owner = symbols[keep], owner[keep]
    out = np.zeros(len(texts) * dims)
    for n in (2, 3):
        if symbols.size < n:
            continue
        code = symbols[: symbols.size - n + 1].copy()
        for i in range(1, n):
            code = code * np.uint32(257) + symbols[i : symbols.size - n + 1 + i]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - int(dims).bit_length() + 1)
        first = owner[: code.size]
        whole = first == owner[n - 1 :]
        out += np.bincount(first[whole] * dims + code[whole], minlength=out.size)
    return out.reshape(len(texts), dims)


def unit_rows(x: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(length > 0, length, 1)[:, None]


@dataclass
class LanguageModel:
    """Centroids with their language, and what cosine their texts have.

    A long text of the centroid's language has about its ``peak``, a short one, with few n-grams, about
    ``rate`` times the sum of its vector. A text is too far if its cosine is below ``accept`` times the lesser.
    """

    langs: list[str]
    centroids: np.ndarray
    peak: np.ndarray
    rate: np.ndarray
    idf: np.ndarray
    accept: float
    texts: dict[str, int] = field(default_factory=dict)  # distinct texts that each language was clustered on

    def vectors(self, texts: pa.Array) -> np.ndarray:
        """Unit TF-IDF vectors; counts enter by 1 + log."""
        counts = ngram_counts(texts, self.idf.size)
        return unit_rows(np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * self.idf)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = self.vectors(texts)
        cosine = x @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = cosine[np.arange(len(texts)), best]
        sure = lettered & (score >= self.accept * np.minimum(self.peak[best], self.rate[best] * x.sum(1)))
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, sure)], np.where(lettered, np.clip(score, 0, 1), 0.0)


def _cluster(x: np.ndarray, k: int, rounds: int = 12, least: float = 0.02) -> np.ndarray:
    """Spherical k-means, started from rows spread evenly by their cosine to the mean.

    Clusters with less than the share ``least`` of the rows are mislabelled or odd texts; they are dropped.
    """
    order = np.argsort(x @ x.mean(0), kind="stable")
    centroids = x[order[(np.arange(min(k, len(x))) * 2 + 1) * len(x) // (2 * min(k, len(x)))]]
    for _ in range(rounds):
        of = (x @ centroids.T).argmax(1)
        centroids = unit_rows(np.stack([x[of == j].sum(0) if (of == j).any() else centroids[j] for j in range(len(centroids))]))
    sizes = np.bincount((x @ centroids.T).argmax(1), minlength=len(centroids))
    return centroids[sizes >= min(least * len(x), sizes.max())]


def _least(known: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` least distinct values of both."""
    return np.unique(np.concatenate([known, hashes]))[:n]


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row per language and text hash; each task sends a text on once."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            first = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            if first:
                yield batch.take(pa.array(first))

    return rows.mapInArrow(once, "text string, lang string, h bigint").dropDuplicates(["lang", "h"])


def fit_languages(
    docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", dims: int = 4096, centroids: int = 4,
    per_lang: int = 400, accept: float = 0.2,
) -> LanguageModel:
    """Centroids learned from the rows of ``train`` that have a language and a text.

    Document frequencies count all training rows, summed per task first. Each language is clustered on its
    ``per_lang`` distinct texts of least hash, or on all it has if they are fewer, whatever their numbers of
    copies; so every language with a training text has a centroid. ``accept`` is the share of the cosine to
    expect below which a text is rejected.
    """
    rows = docs.filter(train).select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(7)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, least = np.zeros(dims), 0, {}
        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts, rows=512):
                seen += (ngram_counts(texts.slice(a, b - a), dims) > 0).sum(0)
            total += len(batch)
            coded, hashes = pc.dictionary_encode(batch.column(1)), batch.column(2).to_numpy()
            codes = coded.indices.to_numpy()
            for i, name in enumerate(coded.dictionary.to_pylist()):
                least[name] = _least(least.get(name, hashes[:0]), hashes[codes == i], per_lang)
        owner = [name for name, known in least.items() for _ in known]
        yield pa.RecordBatch.from_pydict(
            {"seen": [seen.astype(np.int64).tolist()], "total": [total], "langs": [owner], "hashes": [[int(h) for x in least.values() for h in x]]},
            schema=pa.schema([("seen", pa.list_(pa.int64())), ("total", pa.int64()), ("langs", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64()))]),
        )

    parts = materialize(rows.mapInArrow(frequencies, "seen array<bigint>, total bigint, langs array<string>, hashes array<bigint>"))
    # One row per n-gram bucket, and one per language.
    seen = dict(parts.select(F.posexplode("seen").alias("i", "n")).groupBy("i").agg(F.sum("n")).collect())
    total = parts.agg(F.sum("total")).first()[0] or 0
    texts_of = parts.select(F.explode(F.arrays_zip("langs", "hashes")).alias("x")).select(F.col("x.langs").alias("lang"), F.col("x.hashes").alias("h")).distinct()
    placed = texts_of.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("place") <= per_lang)
    # The greatest hash drawn of every language, and how many are.
    drawn = {r["lang"]: (r["last"], r["n"]) for r in placed.groupBy("lang").agg(F.max("h").alias("last"), F.count("*").alias("n")).collect()}
    idf = np.log((1 + total) / (1 + np.array([seen.get(i, 0) for i in range(dims)]))) + 0.05
    model = LanguageModel([], np.zeros((0, dims)), np.zeros(0), np.zeros(0), idf, accept)
    if not drawn:
        return model
    last = F.create_map(*[F.lit(v) for name, (h, _) in sorted(drawn.items()) for v in (name, h)])

    def sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts, rows=512):
                x = model.vectors(texts.slice(a, b - a)).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.tobytes() for row in x], pa.binary()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["vector", "lang", "h"]
                )

    def cluster(key: tuple, table: pa.Table) -> pa.Table:
        # At most per_lang vectors of a fixed size; they come in any order.
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, dims).astype(float)[order]
        c = _cluster(x, centroids)
        cosine = x @ c.T
        of = cosine.argmax(1)
        own = [of == j if (of == j).any() else np.ones(len(x), bool) for j in range(len(c))]
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(c), pa.string()), "n": pa.array([len(x)] * len(c), pa.int64()), "place": pa.array(np.arange(len(c))),
            "centroid": pa.array([v.tobytes() for v in c], pa.binary()), "peak": pa.array([float(np.median(cosine[m, j])) for j, m in enumerate(own)]),
            "rate": pa.array([float(np.median(cosine[m, j] / np.maximum(x[m].sum(1), 1e-9))) for j, m in enumerate(own)]),
        })

    chosen = _one_of_each(rows.filter(F.col("h") <= last[F.col("lang")]))
    sample = chosen.mapInArrow(sample_vectors, "vector binary, lang string, h bigint")
    shape = "lang string, n bigint, place bigint, centroid binary, peak double, rate double"
    # A few centroids a language.
    learned = sorted(sample.groupBy("lang").applyInArrow(cluster, shape).collect(), key=lambda r: (r["lang"], r["place"]))
    for name in sorted(drawn):
        mine = [r for r in learned if r["lang"] == name]
        if not mine or mine[0]["n"] != drawn[name][1]:
            raise RuntimeError(f"{mine[0]['n'] if mine else 0} training texts of {name!r} where {drawn[name][1]} were drawn")
        model.texts[name] = mine[0]["n"]
        model.langs += [name] * len(mine)
        model.centroids = np.vstack([model.centroids, *[np.frombuffer(r["centroid"])[None] for r in mine]])
        model.peak = np.append(model.peak, [r["peak"] for r in mine])
        model.rate = np.append(model.rate, [r["rate"] for r in mine])
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its cosine, 0 to 1, to every row, from the whole text alone.

    ``und`` where the text is null or empty, has no letter (score 0), or lies farther from every centroid than
    the centroid accepts (score is then the cosine that fell short). Equal texts get equal answers. Columns
    named like the added ones are replaced. Texts are read in slices of bounded size; a very long text is a
    slice of its own.
    """
    kept = docs.drop(out, score)
    names = kept.columns
    schema = grown(kept.schema, **{out: "string", score: "double"})

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text))
            found, scores = [], [np.zeros(0)]
            for a, b in slices(texts, rows=512):
                langs, values = model.predict(texts.slice(a, b - a))
                found += langs
                scores.append(values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(np.concatenate(scores), pa.float64())], [*names, out, score]
            )

    return kept.mapInArrow(predict, schema)
