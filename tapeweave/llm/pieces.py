"""N-best segmentation into the pieces of a SentencePiece model, and decoding back to text."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tapeweave.llm.arrowtext import Ranges, distinct, grown, mix, slices, spread, text_bytes, word_hashes

#: The escaped space of piece strings, and what stands for that letter where a text itself has it.
SPACE, OWN_SPACE = 0x2581, 0x110000
#: What a character that no piece covers costs below the least score of a single one; it becomes its UTF-8 bytes.
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x100000001B3)


class PieceModel:
    """Pieces, their scores, and the lattice search. Pieces come from a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = np.full(256, model.unk_id(), np.int32)
        self.pieces: dict[str, tuple[int, float]] = {}
        text = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.bytes_of[int(name[3:5], 16)] = i
                text.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                text.append(b"")
            else:
                self.pieces[name] = (i, model.get_score(i))
                text.append(name.replace(chr(SPACE), " ").encode())
        self.text = Ranges(np.uint8)
        self.text.extend(np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text]))
        self.longest = max(map(len, self.pieces))
        self.unknown = min((s for p, (_, s) in self.pieces.items() if len(p) == 1), default=0.0) - UNKNOWN_PENALTY
        # Texts are cut before runs of spaces and around line ends, which is exact if no piece spans a cut.
        spans = [p for p in self.pieces if "\n" in p or chr(SPACE) in p.lstrip(chr(SPACE))]
        if spans:
            raise ValueError(f"pieces span words: {spans[:3]}")
        self._index()

    def _index(self) -> None:
        """Tables from hashes of all piece prefixes to the piece; what collides moves on to the next table."""
        prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        left = {}
        for p in sorted(prefixes):
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) % 2**64
            left[h] = self.pieces.get(p, (-1, -np.inf))
        self.tables = []
        while left:
            keys = np.fromiter(left, np.uint64, len(left))
            slot = self._slot(keys, len(self.tables))
            first = np.unique(slot, return_index=True)[1]
            key, number, score = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int32), np.full(1 << 18, -np.inf)
            placed = keys[first].tolist()
            key[slot[first]] = keys[first]
            number[slot[first]] = [left[k][0] for k in placed]
            score[slot[first]] = [left[k][1] for k in placed]
            self.tables.append((key, number, score))
            for k in placed:
                del left[k]

    @staticmethod
    def _slot(h: np.ndarray, table: int) -> np.ndarray:
        return (mix(h + np.uint64(table)) >> np.uint64(46)).astype(np.int64)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each hash is a prefix, its piece (-1: none) and that piece's score."""
        known, number, score = np.zeros(h.size, bool), np.full(h.size, -1, np.int32), np.full(h.size, -np.inf)
        at = np.arange(h.size)
        for t, (key, numbers, scores) in enumerate(self.tables):
            slot = self._slot(h, t)
            there = key[slot]
            hit = there == h
            known[at[hit]], number[at[hit]], score[at[hit]] = True, numbers[slot[hit]], scores[slot[hit]]
            # Only what meets another prefix in its slot may have moved on.
            on = np.flatnonzero(~hit & (there != 0))
            at, h = at[on], h[on]
        return known, number, score

    def lattice(self, chars: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, length, piece and score of every edge; ``stops`` is each start's end of unit."""
        at, h = np.arange(chars.size), np.zeros(chars.size, np.uint64)
        found = []
        for k in range(self.longest):
            at_ok = at + k < stops[at]
            at, h = at[at_ok], h[at_ok]
            if not at.size:
                break
            h = h * _BASE + (chars[at + k].astype(np.uint64) + np.uint64(1))
            known, number, score = self._find(h)
            if k == 0:
                none = number < 0
                number[none], score[none] = -2, self.unknown
            some = np.flatnonzero(number != -1)
            found.append((at[some], np.full(some.size, k + 1), number[some], score[some]))
            at, h = at[known], h[known]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def best(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best pieces of every unit (flat, with counts), their scores, and the loss of the second best (inf: none).

        Viterbi forward and backward over all units side by side. Among equal sums the longer first piece wins.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum(sizes) - sizes
        stops = np.repeat(begins + sizes, sizes)
        chars = np.where(chars == SPACE, OWN_SPACE, np.where(chars == 32, SPACE, chars))
        start, length, number, score = self.lattice(chars, stops)
        # Nodes: one per character and one at the end of each unit.
        nodes = begins + np.arange(len(units))
        owner = np.repeat(np.arange(len(units)), sizes)[start]
        source = start + owner
        target = source + length
        total = chars.size + len(units)
        forward, backward = np.full(total, -np.inf), np.full(total, -np.inf)
        forward[nodes], backward[nodes + sizes] = 0, 0
        # Edges by the distance of the node that they lead to from its unit's front; every node but the front has some.
        depth = target - nodes[owner]
        order = np.argsort(depth * total + target)
        goal, origin, cost = target[order], source[order], score[order]
        group = np.flatnonzero(np.diff(goal, prepend=-1))
        edges, groups = _levels(depth[order], group)
        for (a, b), (c, d) in zip(edges, groups):
            forward[goal[group[c:d]]] = np.maximum.reduceat(forward[origin[a:b]] + cost[a:b], group[c:d] - a)
        # And by the distance of the node that they leave from its unit's end, longer ones first.
        depth = sizes[owner] + nodes[owner] - source
        order = np.argsort((depth * total + source) * (self.longest + 1) - length)
        goal, origin, cost = target[order], source[order], score[order]
        group = np.flatnonzero(np.diff(origin, prepend=-1))
        edges, groups = _levels(depth[order], group)
        sums = np.zeros(order.size)
        for (a, b), (c, d) in zip(edges, groups):
            sums[a:b] = cost[a:b] + backward[goal[a:b]]
            backward[origin[group[c:d]]] = np.maximum.reduceat(sums[a:b], group[c:d] - a)
        top = np.flatnonzero(sums == backward[origin])
        top = top[np.flatnonzero(np.diff(origin[top], prepend=-1))]
        take = np.zeros(total, np.int64)
        take[origin[top]] = order[top]
        scores = backward[nodes]
        # Follow the best edges of all units at once.
        chosen, at, unit = [], nodes.copy(), np.arange(len(units))
        off_path = np.ones(start.size, bool)
        while at.size:
            live = at < (nodes + sizes)[unit]
            at, unit = at[live], unit[live]
            chosen.append((unit, at))
            off_path[take[at]] = False
            at = at + length[take[at]]
        second = np.full(len(units), -np.inf)
        np.maximum.at(second, owner[off_path], (forward[source] + score + backward[target])[off_path])
        unit = np.concatenate([u for u, _ in chosen]) if chosen else np.zeros(0, np.int64)
        at = np.concatenate([a for _, a in chosen]) if chosen else np.zeros(0, np.int64)
        sort = np.argsort(at, kind="stable")
        unit, at = unit[sort], at[sort]
        flat, counts = self._bytes(number[take[at]], chars[at - unit], unit, len(units))
        return flat, counts, scores, scores - second

    def _bytes(self, numbers: np.ndarray, chars: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids with uncovered characters as their bytes, and the count of ids per unit."""
        odd = np.flatnonzero(numbers == -2)
        if odd.size:
            spelled = [self.spell(int(c)) for c in chars[odd]]
            sizes = np.ones(numbers.size, np.int64)
            sizes[odd] = [len(s) for s in spelled]
            out = np.repeat(numbers, sizes)
            out[spread((np.cumsum(sizes) - sizes)[odd], sizes[odd])] = np.concatenate(spelled)
            return out, np.bincount(np.repeat(unit, sizes), minlength=n)
        return numbers, np.bincount(unit, minlength=n)

    def spell(self, char: int) -> np.ndarray:
        raw = chr(SPACE if char == OWN_SPACE else char).encode("utf-8", "surrogatepass")
        return self.bytes_of[np.frombuffer(raw, np.uint8)]

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a unit, by score; equal ones in the order of the search.

        Forward Viterbi scores are the exact rest costs of an A* search that runs backward from the end, so
        partial paths leave the queue in order of the score of the whole path they lead to. Of equal ones the
        one nearest to the start goes first, so ties don't widen the search.
        """
        chars = [OWN_SPACE if c == chr(SPACE) else SPACE if c == " " else ord(c) for c in unit]
        size = len(chars)
        names = "".join(chr(c) if c != OWN_SPACE else "\0" for c in chars)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        forward = [0.0] + [-np.inf] * size
        for end in range(1, size + 1):
            for k in range(1, min(self.longest, end) + 1):
                piece = self.pieces.get(names[end - k : end])
                if piece is None and k == 1:
                    piece = (-2, self.unknown)
                if piece is not None:
                    into[end].append((end - k, piece[0], piece[1]))
                    forward[end] = max(forward[end], forward[end - k] + piece[1])
        # Whole score, place, number of the entry, score behind the place, and the pieces behind it as a linked list.
        queue: list[tuple] = [(-forward[size], size, 0, 0.0, None)]
        found, pushed = [], 0
        while queue and len(found) < n:
            total, at, _, done, path = heapq.heappop(queue)
            if at == 0:
                ids, i = [], 0
                while path is not None:
                    (k, number), path = path
                    ids += [number] if number >= 0 else self.spell(chars[i]).tolist()
                    i += k
                found.append((-total, ids))
                continue
            for start, number, s in into[at]:
                pushed += 1
                heapq.heappush(queue, (-(forward[start] + s + done), start, pushed, done + s, ((at - start, number), path)))
        return found


class Segmenter:
    """Segments texts unit by unit and remembers at most ``most`` units; units are told apart by 64-bit hashes."""

    def __init__(self, path: str, n: int, most: int = 250_000):
        self.model, self.n, self.most = PieceModel(path), n, most
        self.reset()

    def reset(self) -> None:
        self.index: dict[int, int] = {}
        self.ids = Ranges(np.int32)
        self.scores, self.gaps = np.zeros(1 << 14), np.zeros(1 << 14)
        self.searched: dict[int, list[tuple[float, list[int]]]] = {}

    def _learn(self, keys: list[int], units: list[str]) -> None:
        for at in range(0, len(units), 4096):
            part = units[at : at + 4096]
            flat, counts, scores, gaps = self.model.best(part)
            start = self.ids.n
            self.index.update(zip(keys[at : at + 4096], range(start, start + len(part))))
            self.ids.extend(flat, counts)
            while self.ids.n > self.scores.size:
                self.scores, self.gaps = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.gaps))
            self.scores[start : self.ids.n], self.gaps[start : self.ids.n] = scores, gaps

    def segment(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[dict]], np.ndarray]:
        """Best ids of all texts, where each text's ids end, the ranked segmentations, and whether decoding gives the text."""
        data, offsets = text_bytes(texts)
        data, bounds = _prefixed(data, offsets)
        starts, ends, cuts = _units(data, bounds)
        codes, hashes, first = distinct(word_hashes(data, starts, ends))
        keys, raw = hashes.tolist(), data.tobytes()
        new = [i for i, k in enumerate(keys) if k not in self.index]
        if new and len(self.index) + len(new) > self.most:
            self.reset()
            new = list(range(len(keys)))
        if new:
            at = first[new]
            self._learn([keys[i] for i in new], [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        numbers = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[codes]
        flat, sizes = self.ids.take(numbers)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        scores, gaps = self.scores[numbers], self.gaps[numbers]
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        ranked = []
        for t in range(len(texts)):
            a, b = int(cuts[t]), int(cuts[t + 1])
            ids = flat[upto[a] : upto[b]]
            best = float(sums[b] - sums[a])
            out = [_row(best, ids)]
            # Changing any other unit costs no less than each of these n - 1 changes alone.
            want = self.n - 1
            here = gaps[a:b]
            if want and b > a:
                near = np.flatnonzero(here <= np.partition(here, want - 1)[want - 1]) if here.size > want else np.arange(here.size)
                near = near[np.argsort(here[near], kind="stable")][:want]
                near = near[np.isfinite(here[near])]
                combos: list[tuple[float, tuple]] = [(0.0, ())]
                found = {}
                for u in near.tolist():
                    options = found[a + u] = self._alternatives(int(numbers[a + u]), raw[starts[a + u] : ends[a + u]])
                    top = options[0][0]
                    combos = sorted(
                        ((loss + top - s, (*changes, (a + u, r)) if r else changes) for loss, changes in combos for r, (s, _) in enumerate(options)),
                    )[: self.n]
                for loss, changes in combos[1:]:
                    parts, done = [], upto[a]
                    for u, r in sorted(changes):
                        parts += [flat[done : upto[u]], np.array(found[u][r][1], np.int32)]
                        done = upto[u + 1]
                    out.append(_row(best - loss, np.concatenate([*parts, flat[done : upto[b]]])))
            ranked.append(out)
        stops = upto[cuts[1:]]
        raw_ids, sizes = self.model.text.take(flat)
        if np.array_equal(raw_ids, data):
            same = np.ones(len(texts), bool)
        else:
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], stops])]
            same = np.array([np.array_equal(raw_ids[ends[t] : ends[t + 1]], data[bounds[t] : bounds[t + 1]]) for t in range(len(texts))], bool)
        return flat, stops, ranked, same

    def _alternatives(self, number: int, raw: bytes) -> list[tuple[float, list[int]]]:
        if number not in self.searched:
            if len(self.searched) >= self.most // 8:
                self.searched.clear()
            own = self.ids.take(np.array([number]))[0].tolist()
            found = self.model.n_best(raw.decode("utf-8", "surrogatepass"), self.n)
            others = [x for x in found if x[1] != own]
            # The best of the search may be another one of the same score.
            self.searched[number] = [(found[0][0], own), *others][: self.n]
        return self.searched[number]


def _levels(depth: np.ndarray, group: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of edges of equal depth, which come in order, and of the groups that begin in them."""
    cuts = np.append(np.flatnonzero(np.diff(depth, prepend=-1)), depth.size)
    of = np.searchsorted(group, cuts)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist())), list(zip(of[:-1].tolist(), of[1:].tolist()))


def _row(score: float, ids: np.ndarray) -> dict:
    return {"score": score, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def _prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that is not empty."""
    full = np.flatnonzero(np.diff(offsets))
    grown = np.insert(data, offsets[full], 32)
    more = np.zeros(offsets.size, np.int64)
    more[full + 1] = 1
    return grown, offsets + np.cumsum(more)


def _units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges cut before every run of spaces and around every line end, and the first range of each text."""
    cut = np.zeros(data.size + 1, bool)
    space, line = data == 32, data == 10
    cut[1:-1] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    cut[bounds] = True
    spots = np.flatnonzero(cut)
    if data.size == 0:
        spots = spots[:0]
    return spots[:-1], spots[1:], np.searchsorted(spots[:-1], bounds)


_segmenters: dict[tuple[str, int], Segmenter] = {}
NBEST = "array<struct<score:double,n_tokens:bigint,ids_crc32:bigint>>"


def encode_pieces(
    docs: DataFrame, model: str, n: int = 3, text: str = "text", out: str = "ids", ranked: str = "nbest", same: str = "round_trip",
) -> DataFrame:
    """Replaces the text by the ids of its best segmentation, the ``n`` best ones' score, length and CRC-32, and
    whether decoding the ids gives the text back.

    The whole text is segmented, with the space that the model puts before it; spaces and line ends stay.
    Characters without a piece become their UTF-8 bytes, also the letter that pieces use for a space, so
    ``decode_pieces`` gives every text back; the same table decodes here, next to the encoded ids. Null and empty texts have no ids and one segmentation of score 0. Fewer
    than ``n`` are listed where a text has fewer. A text's n best differ from its best one in the n - 1 units
    whose second choice costs least, so only those are searched.
    """
    kept = docs.drop(*[c for c in (out, ranked, same) if c != text])
    names = kept.columns
    others = [c for c in names if c != text]
    schema = grown(kept.select(*others).schema, **{out: "array<int>", ranked: NBEST, same: "boolean"})
    kind = pa.list_(pa.struct([("score", pa.float64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, n) not in _segmenters:
            _segmenters[model, n] = Segmenter(model, n)
        segmenter = _segmenters[model, n]
        for batch in batches:
            texts = batch.column(names.index(text))
            for a, b in slices(texts, limit=1 << 20):
                flat, stops, rows, back = segmenter.segment(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(names.index(c)).slice(a, b - a) for c in others], lists, pa.array(rows, kind), pa.array(back)],
                    [*others, out, ranked, same],
                )

    return kept.mapInArrow(encode, schema)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of every list of ids; the space before the text goes. Null lists have null texts."""
    kept = encoded.drop(out)
    names = kept.columns
    schema = grown(kept.schema, **{out: "string"})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, 1) not in _segmenters:
            _segmenters[model, 1] = Segmenter(model, 1)
        pieces = _segmenters[model, 1].model.text
        for batch in batches:
            lists = batch.column(names.index(ids))
            texts = []
            for at in range(0, len(lists), 1024):
                part = lists.slice(at, 1024)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                raw, sizes = pieces.take(flat)
                upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
                raw = raw.tobytes()
                for i, missing in enumerate(part.is_null().to_pylist()):
                    whole = raw[upto[i] : upto[i + 1]]
                    texts.append(None if missing else (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return kept.mapInArrow(decode, schema)
