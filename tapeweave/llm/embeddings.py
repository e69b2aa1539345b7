"""Near-duplicate embeddings by tiled comparison in the order of the principal components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.graph import components
from tapeweave.session import materialize

#: What rounding may take from a bound; survivors are compared again on the vectors as given.
SLACK = 1e-9


def clean_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Per row: id, and for usable vectors key (hash of the values) and vec (their bytes as doubles).

    A vector is usable if it is not null, has no null or non-finite component, and has a positive, finite
    length in double precision.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            for value in batch.column(1):
                values = value.values
                raw = None
                if values is not None and len(values) and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
                    norm = math.sqrt(float(x @ x)) if np.isfinite(x).all() else 0.0
                    if norm > 0 and math.isfinite(norm):
                        raw = x.astype("<f8").tobytes()
                raws.append(raw)
                keys.append(None if raw is None else hashlib.md5(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["id", "key", "vec"])

    picked = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "id bigint, key binary, vec binary")


def _matrix(raws: list[bytes], dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    if all(len(r) == 8 * dims for r in raws):
        return np.frombuffer(b"".join(raws), "<f8").reshape(-1, dims)
    return np.stack([np.pad(np.frombuffer(r, "<f8"), (0, dims - len(r) // 8)) for r in raws]) if raws else np.zeros((0, dims))


def principal_axes(nodes: DataFrame, dims: int) -> np.ndarray:
    """Orthogonal axes of the unit vectors, columns in order of falling second moment.

    Every task sums its products; the sums of all tasks are added entry by entry, so the driver gets a row per
    entry of the matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), dims)
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    entries = nodes.select("vec").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x"))
    found = dict(entries.groupBy("i").agg(F.sum("x")).collect())
    moments = np.array([found.get(i, 0.0) for i in range(dims * dims)]).reshape(dims, dims)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


def near_pairs(a: np.ndarray, b: np.ndarray, tails_a: np.ndarray, tails_b: np.ndarray, least: float, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (rotated unit vectors) whose cosine may reach ``least``.

    Leading ``step`` dimensions first; what is left of a pair's product is at most the product of the norms of
    the two suffixes (``tails``, a column per multiple of ``step``). Pairs whose bound falls short stop there,
    the others go on with the next dimensions, one by one where few are left, else the whole tile.
    """
    part = a[:, :step] @ b[:, :step].T
    i, j = np.nonzero(part + np.outer(tails_a[:, 1], tails_b[:, 1]) >= least - SLACK)
    if i.size > part.size // 16:
        part += a[:, step:] @ b[:, step:].T
        return np.nonzero(part >= least - SLACK)
    value = part[i, j]
    for k in range(1, tails_a.shape[1] - 1):
        if not i.size:
            break
        at = slice(k * step, (k + 1) * step)
        value = value + np.einsum("ij,ij->i", a[i, at], b[j, at])
        live = value + tails_a[i, k + 1] * tails_b[j, k + 1] >= least - SLACK
        i, j, value = i[live], j[live], value[live]
    return i, j


def _join_labels(labels: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (least index of a component) after linking p and q."""
    while True:
        x, y = labels[p], labels[q]
        if (x == y).all():
            return labels
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _partners(low: np.ndarray, high: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last bin that each bin of rising spans has to meet: those at most ``gap`` away."""
    last = np.searchsorted(low, high + gap, "right") - 1
    # From the same comparison, so that meeting is mutual.
    return np.searchsorted(last, np.arange(len(low)), "left"), last


def _tiles(spark: SparkSession, binned: DataFrame, rows: int, gap: float) -> DataFrame:
    """Per bin of the leading coordinate: its tiles (``start`` and ``parts``) and the tiles they meet, ``first`` to ``last``.

    The driver gets a row per bin, that is per ``rows`` vectors; the table goes back as rows, not into a plan.
    Where equal coordinates make a bin too large, hashes split it into several tiles.
    """
    found = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).orderBy("bin").toArrow()
    n, low, high = (found.column(c).to_numpy() for c in ("n", "low", "high"))
    parts = -(-n // (2 * rows))
    ends = np.cumsum(parts)
    first, last = _partners(low, high, gap)
    start = ends - parts
    table = pa.table({"_bin": found.column("bin"), "start": start, "parts": parts, "first": start[first], "last": ends[last] - 1})
    return spark.createDataFrame(table)


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, rows: int = 8192, inner: int = 1024, step: int = 16,
) -> DataFrame:
    """Per row: id, n_links (other rows with a cosine of at least ``least``), component_id and kept.

    Equal vectors become one node with a count. Nodes are rotated onto their principal axes, laid out in tiles
    by the leading coordinate, and tiles meet pairwise unless their spans are farther apart than two unit
    vectors of that cosine can be. Each meeting is a task of at most a few tiles' rows; it compares smaller
    tiles dimension by dimension (``near_pairs``) and checks survivors by the cosine of the vectors as given,
    in double precision. It returns a count and a local component per linked vector, never the pairs.
    Components are joined across tiles; component_id is the least id in it.

    Null, zero and non-finite vectors have no links and are components by themselves; vectors of different
    length never link; repeated rows are different vectors that are equal. Other columns are not read.
    """
    cleaned = materialize(clean_vectors(vectors, id_col, vec_col))
    nodes = materialize(
        cleaned.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    dims = (nodes.agg(F.max(F.length("vec"))).first()[0] or 8) // 8
    axes = principal_axes(nodes, dims)
    lead = axes[:, 0].copy()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2).to_pylist(), dims)
            z = (x @ lead) / np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], ["node", "copies", "vec", "z"])

    ordered = materialize(nodes.select("node", "copies", "vec").mapInArrow(project, "node bigint, copies bigint, vec binary, z double"))
    count = max(1, -(-ordered.count() // rows))
    cuts = np.unique(ordered.approxQuantile("z", [k / count for k in range(1, count)], 0.25 / count)) if count > 1 else np.zeros(0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.searchsorted(cuts, batch.column(3).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int64())], ["node", "copies", "vec", "z", "bin"])

    binned = ordered.mapInArrow(place, "node bigint, copies bigint, vec binary, z double, bin bigint")
    gap = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    meetings = (
        binned.join(_tiles(vectors.sparkSession, binned.select("bin", "z"), rows, gap), F.col("bin") == F.col("_bin"))
        .withColumn("tile", F.col("start") + F.pmod(F.xxhash64("node"), "parts"))
        .withColumn("other", F.explode(F.sequence("first", "last")))
        .select("node", "copies", "vec", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    )
    stops = [min(k, dims) for k in range(0, dims + step, step)]

    def meet(table: pa.Table) -> pa.Table:
        raw = table.column("vec").to_pylist()
        x = _matrix(raw, dims)
        size = np.array([len(r) for r in raw])
        norm = np.linalg.norm(x, axis=1)
        z = (x / norm[:, None]) @ axes
        square = np.concatenate([np.zeros((len(z), 1)), np.cumsum(z[:, ::-1] ** 2, axis=1)], axis=1)
        tails = np.sqrt(square[:, [dims - s for s in stops]])
        copies, tile = table.column("copies").to_numpy(), table.column("tile").to_numpy()
        same = int(table.column("i")[0].as_py()) == int(table.column("j")[0].as_py())
        left = np.flatnonzero(tile == table.column("i")[0].as_py())
        right = left if same else np.flatnonzero(tile == table.column("j")[0].as_py())
        links, labels = np.zeros(len(x), np.int64), np.arange(len(x))
        for p in range(0, len(left), inner):
            for q in range(p if same else 0, len(right), inner):
                u, v = left[p : p + inner], right[q : q + inner]
                i, j = near_pairs(z[u], z[v], tails[u], tails[v], least, step)
                i, j = u[i], v[j]
                keep = size[i] == size[j]
                if same:
                    keep &= i < j
                i, j = i[keep], j[keep]
                for at in range(0, i.size, 1 << 16):
                    a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    near = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= least
                    a, b = a[near], b[near]
                    links += np.bincount(a, copies[b], minlength=len(x)).astype(np.int64) + np.bincount(b, copies[a], minlength=len(x)).astype(np.int64)
                    labels = _join_labels(labels, a, b)
        linked = np.flatnonzero(links)
        node = table.column("node").to_numpy()
        return pa.table({"node": node[linked], "links": links[linked], "root": node[labels[linked]]})

    met = materialize(meetings.groupBy("i", "j").applyInArrow(meet, "node bigint, links bigint, root bigint"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = materialize(
        nodes.select("key", "id", "copies", "node").join(links, "node", "left").join(roots, "node", "left")
        .select("key", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    least_id = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    known = placed.join(least_id, "root").select(F.col("key").alias("_k"), "n_links", "component_id")
    out = cleaned.select("id", "key").join(known, F.col("key") == F.col("_k"), "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
