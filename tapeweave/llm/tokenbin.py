"""Token ids in binary files: a concatenated id array with Elias-Fano coded document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeweave.llm.arrowtext import LOWER, Ranges, distinct, slices, spread, text_bytes, word_hashes, word_spans

MAGIC = b"EFTOK1\x00\x00"
#: Ones between the sampled positions of a select structure.
SAMPLE = 256
_HEAD = struct.Struct("<8sQQQQB7x")


@dataclass
class EliasFano:
    """A non-decreasing sequence below 2**63 in about 2 + log2(last / n) bits an entry.

    ``low`` bits of every value are packed; the rest is a bit vector in which value i sets bit
    ``(value >> low) + i``. ``samples`` holds the place of every 256th set bit, so ``get`` finds entry i by
    counting bits over a short stretch.
    """

    n: int
    low: int
    lower: np.ndarray
    upper: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = values.size
        last = int(values[-1]) if n else 0
        low = max(0, (last // n).bit_length() - 1) if n else 0
        spots = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(spots[-1]) + 1 if n else 0, np.uint8)
        bits[spots] = 1
        shifts = np.arange(low, dtype=np.uint64)
        lower = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, low, np.packbits(lower, bitorder="little"), np.packbits(bits, bitorder="little"), spots[::SAMPLE].astype("<u8"))

    def _lower(self, start: int, stop: int) -> np.ndarray:
        first, last = start * self.low, stop * self.low
        bits = np.unpackbits(self.lower[first // 8 : -(-last // 8)], bitorder="little")[first % 8 : first % 8 + last - first]
        return (bits.reshape(stop - start, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Place of set bit i: from the sample before it, whole bytes at a time."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        bits = int(self.upper[byte]) >> at % 8 << at % 8
        while (here := bits.bit_count()) <= left:
            left -= here
            byte += 1
            bits = int(self.upper[byte])
        for _ in range(left):
            bits &= bits - 1
        return byte * 8 + (bits & -bits).bit_length() - 1

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self.select(i) - i) << self.low | (int(self._lower(i, i + 1)[0]) if self.low else 0)

    def all(self) -> np.ndarray:
        spots = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))
        high = (spots - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        return (high | self._lower(0, self.n) if self.low and self.n else high).astype(np.int64)

    def pack(self) -> bytes:
        parts = [self.lower.tobytes(), self.upper.tobytes(), self.samples.astype("<u8").tobytes()]
        return struct.pack("<QBQQQ", self.n, self.low, *map(len, parts)) + b"".join(parts)

    @classmethod
    def unpack(cls, raw: memoryview) -> tuple[EliasFano, int]:
        n, low, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        cut = lambda start, size, kind: np.frombuffer(raw[start : start + size], kind)
        return cls(n, low, cut(at, a, np.uint8), cut(at + a, b, np.uint8), cut(at + a + b, c, "<u8")), at + a + b + c


def pack_segment(ids: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, nulls: int, width: int) -> bytes:
    """The bytes of a file: header, ends of the documents, document ids, token ids.

    ``doc_ids`` are ascending; the first ``nulls`` of them are null and stored as the least id. They are kept
    as differences to the least one, which the header has.
    """
    least = int(doc_ids[nulls]) if nulls < doc_ids.size else 0
    doc_ids = doc_ids.copy()
    doc_ids[:nulls] = least
    head = _HEAD.pack(MAGIC, ids.size, ends.size, nulls, least & (1 << 64) - 1, width)
    offsets = doc_ids.astype(np.int64).view(np.uint64) - np.uint64(least & (1 << 64) - 1)
    return head + EliasFano.of(ends).pack() + EliasFano.of(offsets).pack() + ids.astype(f"<u{width}").tobytes()


@dataclass
class Segment:
    """A file's documents; ``document(i)`` reads one by two selects."""

    ids: np.ndarray
    ends: EliasFano
    doc_offsets: EliasFano
    nulls: int
    least: int

    @classmethod
    def read(cls, raw: bytes) -> Segment:
        magic, n_ids, n_docs, nulls, least, width = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view, at = memoryview(raw), _HEAD.size
        ends, size = EliasFano.unpack(view[at:])
        docs, more = EliasFano.unpack(view[at + size :])
        ids = np.frombuffer(view[at + size + more :], f"<u{width}")
        if ids.size != n_ids or ends.n != n_docs:
            raise ValueError("the token file is cut")
        return cls(ids, ends, docs, nulls, least)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.get(i - 1) if i else 0 : self.ends.get(i)]

    def doc_ids(self) -> list[int | None]:
        found = (self.doc_offsets.all().view(np.uint64) + np.uint64(self.least)).view(np.int64)
        return [None] * self.nulls + found[self.nulls :].tolist()


class WordTokenizer:
    """Ids of whole texts, encoded by the library part by part and remembered.

    The tokenizer lowers case, drops white space, and never joins letters with marks, so the ids of a text are
    those of its words in order, and of a word's runs of ASCII letters and of marks (other than the
    apostrophe, which contractions keep). Only a special token's name joins them, and only in its own case;
    where one may stand, words stay whole and those with ``<|`` keep their case. Parts are told apart by 64-bit
    hashes; the memory holds at most ``most`` of them.
    """

    def __init__(self, path: str, most: int = 700_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # A digit is a token by itself, so it can stand between words that have none of it.
        mark = self.ids(["0"])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.reset()

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def reset(self) -> None:
        self.index: dict[int, int] = {}
        self.known = Ranges(np.uint32)

    def learn(self, hashes: list[int], words: list[bytes]) -> None:
        """Encode new words, many in one call with a mark between them."""
        plain = [self.mark is not None and b"0" not in w for w in words]
        many = [i for i, p in enumerate(plain) if p]
        for at in range(0, len(many), 512):
            part = many[at : at + 512]
            found = np.array(self.ids([" 0 ".join([words[i].decode() for i in part])])[0], np.uint32)
            marks = np.flatnonzero(found == self.mark)
            sizes = np.diff(np.concatenate([[-1], marks, [found.size]])) - 1
            self._keep([hashes[i] for i in part], found[found != self.mark], sizes)
        rest = [i for i, p in enumerate(plain) if not p]
        lists = self.ids([words[i].decode() for i in rest]) if rest else []
        flat = np.fromiter((i for x in lists for i in x), np.uint32, sum(map(len, lists)))
        self._keep([hashes[i] for i in rest], flat, np.fromiter(map(len, lists), np.int64, len(lists)))

    def _keep(self, hashes: list[int], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(hashes, range(self.known.n, self.known.n + len(hashes))))
        self.known.extend(flat, sizes)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the end offset of each text."""
        given, offsets = text_bytes(texts)
        data = LOWER[given]
        starts, ends, bounds = word_spans(data, offsets)
        names = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        if names.size:
            # Special tokens are matched before case is lowered: words with one of their names stay as given.
            held = np.unique(np.searchsorted(starts, names, "right") - 1)
            at = spread(starts[held], ends[held] - starts[held])
            data[at] = given[at]
        elif data.size:
            starts, ends, bounds = _parts(data, offsets, starts, ends)
        codes, hashes, first = distinct(word_hashes(data, starts, ends))
        keys = hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.index]
        if new and len(self.index) + len(new) > self.most:
            self.reset()
            new = list(range(len(keys)))
        if new:
            at = first[new]
            raw = data.tobytes()
            self.learn([keys[i] for i in new], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        numbers = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[codes]
        flat, sizes = self.known.take(numbers)
        # Each text ends with one more id.
        upto = np.concatenate([[0], np.cumsum(sizes)])
        stops = upto[bounds[1:]] + np.arange(1, bounds.size)
        out = np.full(flat.size + stops.size, end, np.uint32)
        body = np.ones(out.size, bool)
        body[stops - 1] = False
        out[body] = flat
        return out, stops


#: 1 for ASCII letters, 2 for ASCII marks other than the apostrophe.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_KIND[39] = 0
_KIND[97:123] = 1


def _parts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut between letters and marks."""
    kind = _KIND[data]
    cut = np.zeros(data.size + 1, bool)
    cut[1:-1] = (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0)
    cut[offsets] = False
    cuts = np.flatnonzero(cut)
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


_tokenizers: dict[str, WordTokenizer] = {}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors reach."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end: int = 2, segment_ids: int = 1 << 21,
    partitions: int | None = None,
) -> DataFrame:
    """Encode all texts and write the files, in ascending order of id; returns the table of files.

    Files hold up to ``segment_ids`` ids, or one longer document, and are named by their place in the order.
    Each is written under a hidden name and moved, so a task that runs twice leaves the same files. Null ids
    come first, equal ids in order of their texts; null texts are empty; other columns are not read. Ids are
    stored in 2 bytes where the vocabulary allows it, else in 4.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
        .repartitionByRange(n, F.col("id").asc_nulls_first())
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordTokenizer(tokenizer)
        encoder = _tokenizers[tokenizer]
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        files, root = _open(folder)
        ids, ends, names, nulls, size = [], [], [], 0, 0

        def flush() -> dict:
            nonlocal ids, ends, names, nulls, size, at
            path = f"{root}/tokens-{part:06d}-{at:06d}.eft"
            hidden = f"{root}/.tokens-{part:06d}-{at:06d}-{TaskContext.get().taskAttemptId()}"
            raw = pack_segment(np.concatenate(ids), np.concatenate(ends), np.array(names, np.int64), nulls, width)
            with files.open_output_stream(hidden) as f:
                f.write(raw)
            files.move(hidden, path)
            row = {"part": part, "segment": at, "path": path, "n_docs": len(names), "n_ids": size, "n_bytes": len(raw)}
            ids, ends, names, nulls, size, at = [], [], [], 0, 0, at + 1
            return row

        rows = []
        files.create_dir(root, recursive=True)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                found, stops = encoder.encode(texts.slice(a, b - a), end)
                keys = batch.column(0).slice(a, b - a)
                done = 0
                while done < b - a:
                    base = int(stops[done - 1]) if done else 0
                    # As many documents as fit, one at least if the file is still empty.
                    take = int(np.searchsorted(stops, base + segment_ids - size, "right"))
                    if take <= done:
                        if size:
                            rows.append(flush())
                            continue
                        take = done + 1
                    ids.append(found[base : stops[take - 1]])
                    ends.append(stops[done:take] - base + size)
                    names += [0 if k is None else k for k in keys.slice(done, take - done).to_pylist()]
                    nulls += keys.slice(done, take - done).null_count
                    size, done = int(ends[-1][-1]), take
        if size:
            rows.append(flush())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("part", pa.int32()), ("segment", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())
            ]))

    from tapeweave.session import materialize

    return materialize(ordered.mapInArrow(write, "part int, segment int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"))


def read_tokens(files: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: id, start over all files, n_tokens, CRC-32 of its ids, and its ids if asked.

    The table of files has a row per file of megabytes; their starts are a running sum over it.
    """
    placed = files.withColumn(
        "start", F.coalesce(F.sum("n_ids").over(W.orderBy("part", "segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).select("path", "start")
    spark = files.sparkSession
    # A few files a task; the rows are names only.
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(path) as f:
                    segment = Segment.read(f.read())
                stops = segment.ends.all()
                begins = np.concatenate([[0], stops[:-1]])
                wide = segment.ids.astype("<u4")
                view = memoryview(wide).cast("B")
                columns = [
                    pa.array(segment.doc_ids(), pa.int64()), pa.array(start + begins), pa.array(stops - begins),
                    pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), stops.tolist())], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begins[:1], stops]), pa.int32()), pa.array(wide.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return placed.mapInArrow(
        read, f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    )
