"""Spelling variants: words that differ by one code point, found by walking a trie that is a distributed edge table.

Of a word's two ends, one is at least half a word away from the edit. So the front half of a word is taken as it is
and the walk starts at its node; from there the word's states (word, position, node, edits) are joined with the edges
one level at a time: without an edit so far to all edges of the node, after it to the one that matches. The same
is done with all words reversed. A state that ends its word at a node that ends a word is a neighbour.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.llm.arrowtext import LOWER, distinct, owners, slices, spread, text_bytes, word_hashes, word_spans
from tapeweave.session import materialize

#: Words of up to this many code points have a trie with one code point a level; each doubling of the length doubles the step.
LEVELS = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True

#: CRC tables of runs of zero bytes up to this length; longer words take zlib's function one by one.
_SHIFTS = 64


def _crc_shifts() -> np.ndarray:
    """``[n, j, v]``: the CRC-32 register ``v << 8 * j`` after ``n`` zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    out = np.zeros((_SHIFTS + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_SHIFTS):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ step[out[n] & np.uint32(255)]
    return out


_shifts: list[np.ndarray] = []


def _keyed_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, first: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """CRC-32 of every run's bytes after a prefix whose CRC is ``keys``; each distinct run is read once."""
    if not _shifts:
        _shifts.append(_crc_shifts())
    table, raw = _shifts[0], data.tobytes()
    own = np.array([zlib.crc32(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())], np.uint32)
    size = ends - starts
    n = np.minimum(size, _SHIFTS)
    out = own[which]
    for j in range(4):
        out ^= table[n, j, (keys >> np.uint32(8 * j)) & np.uint32(255)]
    for i in np.flatnonzero(size > _SHIFTS).tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]], int(keys[i]))
    return out


def count_variants(docs: DataFrame, id_col: str, text: str, least_len: int, fold: int) -> DataFrame:
    """(word, n) of the words of all texts, after every ``fold``-th run by its hash has lost a code point."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts, limit=1 << 22, rows=1 << 16):
                data, offsets = text_bytes(texts.slice(a, b - a))
                data = LOWER[data]
                letter = _LETTER[data]
                letter[1:] |= data[:-1] == 0xC3
                starts, ends, bounds = word_spans(letter.view(np.uint8), offsets, np.arange(256) == 0)
                wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
                length = ends - starts - (wide[ends] - wide[starts])
                keep = np.flatnonzero(length >= least_len)
                if not keep.size:
                    continue
                keys = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[a:b]], np.uint32)[owners(bounds)[keep]]
                starts, ends, length = starts[keep], ends[keep], length[keep]
                which, _, first = distinct(word_hashes(data, starts, ends))
                h = _keyed_crcs(data, starts, ends, which, first, keys)
                hit = h % np.uint32(fold) == 0
                edited = Counter()
                for i in np.flatnonzero(hit).tolist():
                    run, at = data[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(length[i])
                    edited[run[:at] + run[at + 1 :]] += 1
                n = np.bincount(which[~hit], minlength=first.size)
                first, n = first[n > 0], n[n > 0]
                sizes = (ends - starts)[first]
                flat = data[spread(starts[first], sizes)]
                words = pa.StringArray.from_buffers(first.size, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(flat))
                short = [w for w in edited if len(w) >= least_len]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([words, pa.array(short, pa.string())]), pa.array(np.concatenate([n, [edited[w] for w in short]]).astype(np.int64))],
                    ["word", "n"],
                )

    rows = docs.select(F.col(id_col).cast("string"), F.col(text)).mapInArrow(counts, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _step(length: Column) -> Column:
    """Code points a level of the trie for words of this length."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(length / LEVELS)).cast("double"))).cast("int")


def _node(prefix: Column) -> Column:
    return F.xxhash64("side", "step", prefix)


def _bit(char: Column) -> Column:
    """One of 64 bits for a code point."""
    return F.ascii(char).bitwiseAND(63)


_MASK = lambda place: F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _oriented(words: DataFrame) -> DataFrame:
    """(s, len, side) of every word from the front (side 0) and reversed (side 1)."""
    sides = F.array(F.struct(F.col("word").alias("s"), F.lit(0).alias("side")), F.struct(F.reverse("word").alias("s"), F.lit(1).alias("side")))
    return words.select(F.explode(sides).alias("x")).select("x.s", F.length("x.s").alias("len"), "x.side")


def trie_edges(words: DataFrame) -> DataFrame:
    """(level, node, label, child, ends, lens, next1, next2): the edges that words or their neighbours may pass.

    A node is the hash of the prefix that leads to it. ``ends`` tells whether a word ends at the child; the last
    three are sets, as bits, of how much is left of the words below it and of the next two code points there.
    """
    steps = F.array_distinct(F.array(_step(F.col("len")), _step(F.col("len") - 1)))
    member = _oriented(words).withColumn("step", F.explode(steps))
    # A word is a neighbour of words of its length or one less; these start at their middle.
    begin = F.floor(F.floor((F.col("len") - 1) / 2) / F.col("step")).cast("int")
    last = (F.ceil(F.col("len") / F.col("step")) - 1).cast("int")
    edges = member.withColumn("level", F.explode(F.sequence(begin, last)))
    at = F.col("level") * F.col("step")
    upto = F.least(at + F.col("step"), F.col("len"))
    edges = edges.select(
        "side", "step", "s", "len", "level", at.alias("at"), upto.alias("upto"), F.substring("s", at + 1, F.col("step")).alias("label"),
    )
    left = F.col("len") - F.col("upto")
    following = lambda k: F.when(left >= k, _MASK(_bit(F.substring("s", F.col("upto") + k, F.lit(1))))).otherwise(F.lit(0).cast("bigint"))
    return edges.groupBy(
        "level", _node(F.substring("s", F.lit(1), F.col("at"))).alias("node"), "label", _node(F.substring("s", F.lit(1), F.col("upto"))).alias("child"),
    ).agg(
        F.max(left == 0).alias("ends"), F.bit_or(_MASK(F.least(left, F.lit(62)))).alias("lens"),
        F.bit_or(following(1)).alias("next1"), F.bit_or(following(2)).alias("next2"),
    )


def _walk(words: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, near, side): oriented words and neighbours of the same length or one code point longer."""
    spark = words.sparkSession
    query = materialize(_oriented(words).withColumn("step", _step(F.col("len"))).withColumn("first", F.floor(F.floor(F.col("len") / 2) / F.col("step")).cast("int")))
    low, high = edges.agg(F.min("level"), F.max("level")).first()
    states, found = None, []
    for level in range(low, high + 1) if low is not None else []:
        at = F.lit(level) * F.col("step")
        fresh = query.filter((F.col("first") <= level) & (at <= F.col("len"))).select(
            "s", "len", "side", at.alias("pos"), _node(F.substring("s", F.lit(1), at)).alias("node"), F.lit(None).cast("string").alias("near"),
        )
        frontier = fresh if states is None else fresh.unionByName(states)
        m = F.length("label")
        same = F.substring("s", F.col("pos") + 1, m)
        shorter = F.substring("s", F.col("pos") + 1, m - 1)
        one = lambda a: F.levenshtein(a, F.col("label"), 1) == 1
        edited = F.col("near").isNotNull()
        # A longer label holds the edit anywhere; a label of one code point has to differ, be it in place of the word's or before it.
        replaced = ~edited & F.when(m == 1, (same != F.col("label")) & (same != "")).otherwise((F.length(same) == m) & one(same))
        inserted = ~edited & F.when(m == 1, same != F.col("label")).otherwise((F.length(shorter) == m - 1) & one(shorter))
        goes = F.when(edited & (same == F.col("label")), F.array(F.col("pos") + m)).otherwise(
            F.array_compact(F.array(F.when(replaced, F.col("pos") + m), F.when(inserted, F.col("pos") + m - 1)))
        )
        moved = frontier.join(edges.filter(F.col("level") == level), "node").withColumn("to", F.explode(goes))
        left = F.col("len") - F.col("to")
        sees = lambda mask, k: (left < k) | (F.getbit(mask, _bit(F.substring("s", F.col("to") + k, F.lit(1)))) == 1)
        alive = (F.getbit("lens", F.least(left, F.lit(62))) == 1) & sees("next1", 1) & sees("next2", 2) & ((left > 0) | F.col("ends"))
        after = materialize(moved.filter(alive).select(
            "s", "len", "side", F.col("to").alias("pos"), F.col("child").alias("node"),
            F.coalesce("near", F.concat(F.substring("s", F.lit(1), F.col("pos")), F.col("label"), F.substring("s", F.col("to") + 1, F.col("len")))).alias("near"),
        ))
        found.append(after.filter(F.col("pos") == F.col("len")).select("s", "near", "side"))
        states = after.filter(F.col("pos") < F.col("len"))
    out = spark.createDataFrame([], "s string, near string, side int")
    for part in found:
        out = out.unionByName(part)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of words that differ by one inserted, deleted or replaced code point."""
    ends = _walk(words, materialize(trie_edges(words).sortWithinPartitions("level")))
    turn = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    # Replacements are found from either word; an insertion from the shorter one.
    both = F.when(F.length("s") == F.length("near"), F.array(F.struct(turn("s").alias("word"), turn("near").alias("near")))).otherwise(
        F.array(F.struct(turn("s").alias("word"), turn("near").alias("near")), F.struct(turn("near").alias("word"), turn("s").alias("near")))
    )
    return ends.select(F.explode(both).alias("x")).select("x.*").distinct()


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows: the end of every chain of forms, by doubling.

    Counts at least double along a chain, so it has at most 64 words and six rounds end it.
    """
    paths = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = paths.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = materialize(paths.join(jump, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        paths = after.select("word", "root")
        if after.filter("_moved").isEmpty():
            return paths


def group_spellings(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_len: int = 5, least_n: int = 3, ratio: int = 2, fold: int = 97,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every frequent word and the more frequent spelling it may stand for.

    Runs of ``A-Z a-z U+00C0-U+00FF`` with A-Z in lower case; where ``fold`` divides the CRC-32 of ``id:run``, the run
    loses the code point of that number modulo its length. Words are the results of at least ``least_len`` code
    points (two at least) that occur ``least_n`` times. Two are near if one inserted, deleted or replaced code
    point tells them apart. The form is the near word of largest ``n``, of equal ones the least by code points, if
    its ``n`` is at least ``ratio`` times the word's; ``root`` follows forms to their end and is the word itself
    without one.

    A null text has no words and a null id is empty text; repeated rows count each time; an empty table gives no
    row; other columns are not read. No word is too long: the step of the trie grows with the length.
    """
    if least_len < 2 or ratio < 2:
        raise ValueError("words need two code points at least, and forms twice the count")
    words = materialize(count_variants(docs, id_col, text, least_len, fold).filter(F.col("n") >= least_n))
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # Of the largest counts the least word; equal ones are compared by their bytes, as code points are.
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    judged = materialize(
        words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
        .select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
    )
    roots = follow_forms(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
