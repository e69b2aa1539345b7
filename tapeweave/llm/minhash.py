"""Near-duplicate documents by BagMinHash signatures of their weighted word shingles, banding and verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.llm.arrowtext import Ranges, mix, owners, slices, text_bytes, word_hashes, word_spans
from tapeweave.llm.graph import components
from tapeweave.session import materialize

#: Words of a shingle and the least weighted Jaccard similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Rows of a band and number of bands: a pair of similarity 0.8 misses all bands once in 300,000 times.
ROWS, BANDS = 5, 32
#: Share of equal signature places below which a pair is not verified: six standard deviations under 0.8.
ESTIMATE = 0.6
#: Bits of a shingle's hash.
SHINGLE_BITS = 52


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of every distinct shingle, sorted by text and hash.

    A shingle is ``words`` words in a row; a text with fewer, but at least one, has one shingle of them all.
    """
    data, offsets = text_bytes(texts)
    starts, ends, bounds = word_spans(data, offsets)
    h, owner = word_hashes(data, starts, ends), owners(bounds)
    at, stop = np.arange(h.size), bounds[1:][owner]
    whole = np.zeros(h.size, np.uint64)
    for i in range(words):
        part = np.zeros(h.size, np.uint64)
        part[: h.size - i] = h[i:]
        whole += np.where(at + i < stop, part, np.uint64(0)) * np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64)
    use = (at + words <= stop) | (at == bounds[:-1][owner])
    key = (owner[use].astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (mix(whole[use]) >> np.uint64(64 - SHINGLE_BITS))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [key.size]]))
    key = key[first]
    return (key >> np.uint64(SHINGLE_BITS)).astype(np.int64), key & np.uint64((1 << SHINGLE_BITS) - 1), count


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


def bag_signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, places: int = ROWS * BANDS) -> np.ndarray:
    """BagMinHash signatures, a row of 24-bit codes per text; texts without shingles have zeros.

    Weights are counts: the weight axis of a shingle is cut into cells of width 1, gathered in a hierarchy of
    intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on. Every interval has a Poisson process of points in
    time, seeded by shingle and interval, whose rate is its width times ``places``; each point falls on a
    place and, halving the interval bit by bit, on a cell. A text takes the points whose cell lies below its
    count, and keeps the first point of each place. Two texts keep the same first point with a probability
    equal to their weighted Jaccard similarity.

    Points come in order of time, so a process ends once its next one is later than ``horizon``, by when a
    text has nearly always all places filled; texts that have not are done again with twice the time.
    """
    out = np.zeros((n, places), np.uint32)
    weight = np.bincount(text, count, minlength=n)
    todo = weight > 0
    stretch = 1.0
    empty = np.uint64(2**64 - 1)
    while todo.any():
        use = todo[text] if not todo.all() else slice(None)
        of, x, c = text[use], shingle[use], count[use]
        seed, owner, width, cells = [mix(x)], [of], [np.ones(of.size, np.int64)], [np.ones(of.size, np.int64)]
        level = 1
        many = np.flatnonzero(c > 1)
        while many.size:
            size = 1 << (level - 1)
            seed.append(mix(x[many] + np.uint64(level * 0xA0761D6478BD642F % 2**64)))
            owner.append(of[many])
            width.append(np.full(many.size, size))
            cells.append(np.minimum(size, c[many] - size))
            many = many[c[many] > 2 * size]
            level += 1
        seed, owner, width, cells = map(np.concatenate, (seed, owner, width, cells))
        horizon = stretch * (math.log(places) + 3) / np.maximum(weight, 1)
        best = np.full(n * places, empty)
        time, step = np.zeros(seed.size), 0
        end = horizon[owner]
        while seed.size:
            step += 1
            draw = mix(seed + np.uint64(step * 0x8EBC6AF09C88C6E3 % 2**64))
            time = time - np.log(_uniform(draw)) / (width * places)
            live = time < end
            seed, owner, width, cells, time, end, draw = (v[live] for v in (seed, owner, width, cells, time, end, draw))
            other = mix(draw ^ np.uint64(0xE7037ED1A0B428DB))
            place = ((other >> np.uint64(40)).astype(np.int64) * places) >> 24
            inside = (mix(other) & (width - 1).astype(np.uint64)).astype(np.int64) < cells
            value = ((time / end * 2.0**40).astype(np.uint64) << np.uint64(24)) | (other & np.uint64(0xFFFFFF))
            np.minimum.at(best, (owner * places + place)[inside], value[inside])
        best = best.reshape(n, places)
        done = todo & (best != empty).all(1)
        out[done] = (best[done] & np.uint64(0xFFFFFF)).astype(np.uint32)
        todo &= ~done
        stretch *= 2
    return out


def band_keys(codes: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key per text and band of ``rows`` places."""
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x589965CC75374CC3)
    for i in range(rows):
        h = mix(h + codes[:, i : bands * rows : rows].astype(np.uint64))
    return h.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Per row: id, key (MD5 of the text, null if null), bands and signature (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                n = b - a
                of, shingle, count = shingles(part)
                codes = bag_signatures(of, shingle, count, n)
                worded = np.bincount(of, minlength=n) > 0
                keys = band_keys(codes)
                cuts = np.concatenate([[0], np.cumsum(np.where(worded, BANDS, 0))]).astype(np.int32)
                short = codes.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        pa.array([None if x is None else hashlib.md5(x).digest() for x in part.cast(pa.binary()).to_pylist()], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[worded].ravel())),
                        pa.array([row.tobytes() if w else None for row, w in zip(short, worded)], pa.binary()),
                    ],
                    ["id", "key", "bands", "signature"],
                )

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "id bigint, key binary, bands array<bigint>, signature binary")


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of texts, pair by pair: sum of lesser over sum of greater counts."""
    n = len(left)
    sides = []
    for texts in (left, right):
        of, shingle, count = shingles(texts)
        sides.append(((of.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | shingle, count, np.bincount(of, count, minlength=n)))
    return _shared(*sides)


def _estimated(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough places."""
    places = ROWS * BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(name).to_pylist()), "<u2").reshape(-1, places) for name in ("signature", "other")
            )
            near = (x == y).mean(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(name).filter(pa.array(near)) for name in ("a", "b")], ["a", "b"])

    left = signatures.select(F.col("node").alias("a"), "signature")
    right = signatures.select(F.col("node").alias("b"), F.col("signature").alias("other"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "signature", "other").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with their similarity where it is at least ``least``; ``texts`` has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("text"), batch.column("other")
            for a, b in slices(x, rows=2048):
                for c, d in slices(y.slice(a, b - a), rows=2048):
                    found = similarities(x.slice(a + c, d - c), y.slice(a + c, d - c))
                    near = pa.array(found >= least)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(name).slice(a + c, d - c).filter(near) for name in ("a", "b")], pa.array(found).filter(near)],
                        ["a", "b", "similarity"],
                    )

    right = texts.select(F.col("node").alias("b"), F.col("text").alias("other"))
    left = texts.select(F.col("node").alias("a"), "text")
    return (
        pairs.join(right, "b").join(left, "a").select("a", "b", "text", "other").mapInArrow(run, "a bigint, b bigint, similarity double")
    )


def _compared(members: DataFrame, nodes: DataFrame, least: float, estimate: float, tile: int) -> DataFrame:
    """Links (a, b) between nodes of different ``root`` in the same bucket; ``nodes`` has bands, signature and text."""
    tiles = F.ceil(F.col("n") / tile).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), tiles.cast("bigint")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1))).select(
        "bucket", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def compare(table: pa.Table) -> pa.Table:
        bucket, i, j = (table.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        node, root, own = (table.column(c).to_numpy() for c in ("node", "root", "own"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(-1, ROWS * BANDS)
        texts = table.column("text").combine_chunks()
        ids, counts = Ranges(np.uint64), Ranges(np.int64)
        for a, b in slices(texts):
            of, shingle, count = shingles(texts.slice(a, b - a))
            sizes = np.bincount(of, minlength=b - a)
            ids.extend(shingle, sizes)
            counts.extend(count, sizes)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        band = int(np.flatnonzero(bands[0] == bucket)[0])
        found, pending = [], []

        def settle() -> None:
            p, q = (np.concatenate(x) for x in zip(*pending))
            pending.clear()
            for at in range(0, p.size, 2048):
                x, y = p[at : at + 2048], q[at : at + 2048]
                near = _overlaps(ids, counts, x, y) >= least
                found.append((node[x[near]], node[y[near]]))

        waiting = 0
        for k, x in enumerate(left):
            others = right[k + 1 :] if i == j else right
            others = others[root[others] != root[x]]
            # A pair is compared in the first band it shares, and only if its signatures allow a link.
            others = others[(signature[others] == signature[x]).mean(1) >= estimate]
            others = others[(bands[others] == bands[x]).argmax(1) == band] if others.size else others
            if others.size:
                pending.append((np.full(others.size, x), others))
                waiting += others.size
            if waiting >= 1 << 16:
                settle()
                waiting = 0
        if pending:
            settle()
        both = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ()))]
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    rows = met.join(nodes, "node").select("bucket", "i", "j", "node", "root", "own", "bands", "signature", "text")
    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _overlaps(ids: Ranges, counts: Ranges, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of numbered texts, pair by pair."""
    sides = []
    for side in (x, y):
        shingle, sizes = ids.take(side)
        count, _ = counts.take(side)
        of = np.repeat(np.arange(side.size), sizes)
        sides.append(((of.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | shingle, count, np.bincount(of, count, minlength=side.size)))
    return _shared(*sides)


def _shared(left: tuple, right: tuple) -> np.ndarray:
    """From keys (pair and shingle), counts and totals of both sides: sum of lesser over sum of greater counts."""
    (k1, c1, t1), (k2, c2, t2) = left, right
    _, i, j = np.intersect1d(k1, k2, assume_unique=True, return_indices=True)
    common = np.bincount((k1[i] >> np.uint64(SHINGLE_BITS)).astype(np.int64), np.minimum(c1[i], c2[j]), minlength=t1.size)
    return common / np.maximum(t1 + t2 - common, 1)


def duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, estimate: float = ESTIMATE, tile: int = 1024,
) -> DataFrame:
    """Class of every row: columns id, key (MD5 of the text), class_id, the least id of the class, and
    class_node, which tells classes apart where ids repeat.

    Equal texts are one node. Nodes that share a band are candidates; a pair is linked if the weighted
    Jaccard similarity of its shingles, counted on whole texts, is at least ``similarity``. Classes are the
    connected components of links and equal texts.

    A band's bucket may hold a third of all nodes, so its pairs are not listed. First every node meets the
    least node of its bucket, which joins nearly all copies. Only buckets that this leaves with several
    classes are compared in full: their nodes are dealt into tiles of about ``tile``, two tiles meet in a
    task, and pairs of different classes are compared there, each in the first band that it shares. What
    leaves a task are links. Every candidate pair is thus compared or already in one class.

    Null texts have null keys and are classes by themselves, with their own id. Texts without words are one
    node if equal. A null id counts as greater than all others; repeated rows are equal texts. Texts shorter
    than a shingle are compared as one. Empty input gives no rows.
    """
    sketches = materialize(sketch(docs, id_col, text))
    nodes = materialize(
        sketches.filter("key IS NOT NULL").groupBy("key")
        .agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    signatures = nodes.filter("signature IS NOT NULL").select("node", "signature")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).filter("n > 1")
    members = materialize(buckets.join(shared, "bucket"))

    # The texts of all nodes that any pair can have, one row of each, found by key and id: one pass for all rounds.
    wanted = members.select("node").distinct().join(nodes.select("node", "key", "id"), "node")
    wanted = wanted.select("node", F.col("key").alias("_k"), F.col("id").alias("_i"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    texts = materialize(
        rows.join(wanted, (F.unhex(F.md5("text")) == F.col("_k")) & F.col("id").eqNullSafe(F.col("_i"))).select("node", "text")
    )

    def compare(pairs: DataFrame) -> DataFrame | None:
        near = materialize(_estimated(pairs, signatures, estimate))
        if near.isEmpty():
            return None
        return materialize(_verified(near, texts, similarity).select("a", "b").distinct())

    links = compare(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    roots = components(links) if links is not None else None
    placed = members.select("bucket", "node", "n")
    if roots is not None:
        placed = placed.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    else:
        placed = placed.withColumn("root", F.col("node"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
    open_members = placed.join(split, "bucket")
    found = materialize(_compared(open_members, nodes.select("node", "bands", "signature").join(texts, "node"), similarity, estimate, tile))
    if not found.isEmpty():
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    classes = nodes.select("key", "id", "node")
    if roots is not None:
        classes = classes.join(roots, "node", "left").select("key", "id", F.coalesce("root", "node").alias("root"))
    else:
        classes = classes.withColumnRenamed("node", "root")
    classes = materialize(classes)
    least = classes.groupBy("root").agg(F.min("id").alias("class_id"))
    known = classes.join(least, "root").select(F.col("key").alias("_k"), "class_id", F.col("root").alias("class_node"))
    return sketches.select("id", "key").join(known, F.col("key") == F.col("_k"), "left").select(
        F.col("id").alias(id_col), "key", "class_node", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id")
    )
