"""Phrase collocations from suffix subtrees cut at three words, one group of word prefixes at a time.

Every word of a piece of text starts a suffix, cut after three words. The suffixes are dealt out by their prefix:
one word where its suffixes fit a group's memory budget, two where they don't, three where even those don't. Each
group then builds the subtree of its suffixes on its own, level by level, follows only branches that occur often
enough, and reads the counts of phrases from the totals of the leaves below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeweave.llm.arrowtext import LOWER, distinct, mix, owners, slices, spread, text_bytes, word_hashes, word_spans
from tapeweave.session import materialize

#: Bytes that end a piece.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True

#: Bytes outside words.
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True

#: The language of rows without one.
UNKNOWN = "und"

#: Prefixes of one word are counted in ``2**SLOT_BITS`` slots of the word's hash.
SLOT_BITS = 16

#: As many of the most frequent words travel as two bytes; 0 is the end of a piece and the last number marks a hash.
CODED = (1 << 16) - 2
_ESCAPED = (1 << 16) - 1


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[str]]]:
    """Texts, a language hash per text, language codes and names, in slices of bounded size."""
    texts, coded = batch.column(0), pc.dictionary_encode(batch.column(1).fill_null(UNKNOWN))
    names = coded.dictionary.to_pylist()
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for a, b in slices(texts, limit=1 << 21, rows=1 << 16):
        yield texts.slice(a, b - a), salt[codes[a:b]], codes[a:b], names


def _words(texts: pa.Array, salt: np.ndarray):
    """Bytes, starts, ends and texts of all words, their hashes, which differ by language, and whether the next one is in the same piece."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, GAP)
    of = owners(bounds)
    h = mix(word_hashes(data, starts, ends) ^ salt[of]) if starts.size else np.zeros(0, np.uint64)
    h[h == 0] = 1  # 0 is the end of a piece
    pieces = np.cumsum(BREAK[data])[starts] if starts.size else np.zeros(0, np.int64)
    joined = np.zeros(starts.size, bool)
    joined[:-1] = (of[1:] == of[:-1]) & (pieces[1:] == pieces[:-1])
    return data, starts, ends, of, h, joined


def _followers(h: np.ndarray, joined: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The second and third word of the suffix at every word, or ``end``."""
    second, third = np.full_like(h, end), np.full_like(h, end)
    second[:-1][joined[:-1]] = h[1:][joined[:-1]]
    both = joined[:-2] & joined[1:-1]
    third[:-2][both] = h[2:][both]
    return second, third


def count_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(h, lang, word, n) of every word of every language; counts are added up in tasks first."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, salt, codes, names in _slices(batch):
                data, starts, ends, of, h, _ = _words(texts, salt)
                if not h.size:
                    continue
                which, values, first = distinct(h)
                sizes = (ends - starts)[first]
                ends_at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = data[spread(starts[first], sizes)]
                words = pa.StringArray.from_buffers(first.size, pa.py_buffer(ends_at), pa.py_buffer(flat))
                langs = pa.array(names).take(pa.array(codes[of[first]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), langs, words, pa.array(np.bincount(which).astype(np.int64))], ["h", "lang", "word", "n"]
                )

    rows = docs.select(F.col(text), F.col(lang)).mapInArrow(counts, "h bigint, lang string, word string, n bigint")
    return rows.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Groups:
    """Which group the suffixes of a prefix belong to.

    ``first`` has the group of every slot of first words, or minus one minus the number of a heavy slot. A heavy
    slot's suffixes are dealt by ``bits`` of the second word's hash; ``second`` has the group of each such part,
    from ``begin`` on, or minus one minus the number of a heavy part, whose suffixes are dealt by the third word
    over ``parts`` groups from ``base`` on.
    """

    first: np.ndarray
    bits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    second: np.ndarray | None = None
    base: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    whole: int = 0

    def heavy_parts(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which suffixes start in a heavy slot, and the part of each of them."""
        slot = self.first[(h1 >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        heavy = np.flatnonzero(slot < 0)
        number = -1 - slot[heavy]
        return heavy, self.begin[number] + (h2[heavy] >> (np.uint64(64) - self.bits[number])).astype(np.int64)

    def of(self, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
        group = self.first[(h1 >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
        if self.bits.size:
            heavy, part = self.heavy_parts(h1, h2)
            dealt = self.second[part]
            split = dealt < 0
            number = -1 - dealt[split]
            dealt[split] = self.base[number] + (h3[heavy[split]] >> np.uint64(32)).astype(np.int64) % self.parts[number]
            group[heavy] = dealt
        return group


def _fill(counts: np.ndarray, budget: int, group: int) -> tuple[np.ndarray, int]:
    """Neighbouring prefixes together up to the budget, from group number ``group`` on; heavy ones get -1, -2 and so on."""
    out, filled, heavy = np.zeros(counts.size, np.int64), 0, 0
    for i, n in enumerate(counts.tolist()):
        if n > budget:
            heavy += 1
            out[i] = -heavy
            continue
        if filled + n > budget:
            group, filled = group + 1, 0
        out[i] = group
        filled += n
    return out, group + 1


def plan_groups(docs: DataFrame, words: DataFrame, text: str, lang: str, budget: int) -> Groups:
    """Groups of prefixes of at most ``budget`` suffixes each.

    What reaches the driver is a count per slot, and one per part of the heavy slots: some eight numbers a group.
    """
    slot = F.shiftrightunsigned("h", 64 - SLOT_BITS)
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for s, n in words.groupBy(slot.alias("slot")).agg(F.sum("n")).collect():
        counts[s] = n
    first, used = _fill(counts, budget, 0)
    plan = Groups(first, whole=used)
    heavy = counts[counts > budget]
    if not heavy.size:
        return plan
    plan.bits = np.minimum(24, np.ceil(np.log2(heavy / budget)) + 2).astype(np.uint64)
    plan.begin = np.concatenate([[0], np.cumsum(1 << plan.bits.astype(np.int64))])
    sent = docs.sparkSession.sparkContext.broadcast(plan)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(sent.value.begin[-1], np.int64)
        for batch in batches:
            for texts, salt, _, _ in _slices(batch):
                _, _, _, _, h, joined = _words(texts, salt)
                seen += np.bincount(sent.value.heavy_parts(h, _followers(h, joined, 0)[0])[1], minlength=seen.size)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], ["part", "n"])

    counts = np.zeros(int(plan.begin[-1]), np.int64)
    for part, n in docs.select(text, lang).mapInArrow(parts, "part bigint, n bigint").groupBy("part").agg(F.sum("n")).collect():
        counts[part] = n
    sent.destroy()
    plan.second, plan.whole = _fill(counts, budget, used)
    plan.parts = -(-counts[counts > budget] // budget)
    plan.base = plan.whole + np.concatenate([[0], np.cumsum(plan.parts)[:-1]]).astype(np.int64)
    return plan


def frequent_words(words: DataFrame) -> np.ndarray:
    """Hashes of at most ``CODED`` words: all from the least count on, in steps of a fifth, that so many reach."""
    step = F.floor(F.log2("n") * 4)
    left, least = CODED, None
    # A row per step, from the greatest counts down: a few hundred.
    for row in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        least = row["step"]
    chosen = words.filter(step >= least).select("h").toPandas()["h"] if least is not None else []
    return np.sort(np.array(chosen, np.int64)).view(np.uint64)


_zstd = pa.Codec("zstd", compression_level=1)


def _pack(columns: list[np.ndarray], counts: np.ndarray, values: np.ndarray, code: np.ndarray) -> tuple[int, bytes]:
    """Three columns of local word numbers and the counts, with frequent words as two bytes; its size unpacked."""
    short = [code[c] for c in columns]
    long = [values[c[s == _ESCAPED]] for c, s in zip(columns, short)]
    raw = b"".join([np.uint32(counts.size).tobytes(), *[s.tobytes() for s in short], counts.astype(np.uint32).tobytes(), *[x.tobytes() for x in long]])
    return len(raw), _zstd.compress(raw, asbytes=True)


def _unpack(size: int, packed: bytes, top: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    raw = _zstd.decompress(packed, size, asbytes=True)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    short = np.frombuffer(raw, np.uint16, 3 * n, 4)
    counts = np.frombuffer(raw, np.uint32, n, 4 + 6 * n).astype(np.int64)
    hashes = top[short]
    hashes[short == _ESCAPED] = np.frombuffer(raw, np.uint64, -1, 4 + 10 * n)
    return [hashes[i * n : (i + 1) * n] for i in range(3)], counts


def cut_suffixes(docs: DataFrame, plan: Groups, top: np.ndarray, text: str, lang: str) -> DataFrame:
    """(grp, size, suffixes): the suffixes of a slice of text for one group, equal ones merged, packed."""
    sent = docs.sparkSession.sparkContext.broadcast((plan, top))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, top = sent.value
        order = np.argsort(top)
        for batch in batches:
            for texts, salt, _, _ in _slices(batch):
                _, _, _, _, h, joined = _words(texts, salt)
                if not h.size:
                    continue
                which, values, _ = distinct(h)
                which, values = which + 1, np.concatenate([np.zeros(1, np.uint64), values])
                place = order[np.minimum(np.searchsorted(top, values, sorter=order), top.size - 1)]
                code = np.where(top[place] == values, place, _ESCAPED).astype(np.uint16)
                second, third = _followers(which, joined, 0)
                pairs, pair = np.unique(which * values.size + second, return_inverse=True)
                keys, counts = np.unique(pair * values.size + third, return_counts=True)
                pair, third = pairs[keys // values.size], keys % values.size
                first, second = pair // values.size, pair % values.size
                group = plan.of(values[first], values[second], values[third])
                at = np.argsort(group, kind="stable")
                group = group[at]
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
                packed = [
                    _pack([first[i], second[i], third[i]], counts[i], values, code) for i in (at[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[cuts[:-1]]), pa.array([s for s, _ in packed], pa.int64()), pa.array([p for _, p in packed], pa.binary())],
                    ["grp", "size", "suffixes"],
                )

    return docs.select(text, lang).mapInArrow(cut, "grp bigint, size bigint, suffixes binary")


def count_phrases(suffixes: DataFrame, plan: Groups, top: np.ndarray, least: int) -> DataFrame:
    """(h1, h2, h3, f): phrases of two words (h3 is 0) and three from each group's subtree.

    Phrases of three words are whole. One of two words has a row per group that its suffixes were dealt to, and
    none if its only group finds it less than ``least`` times.
    """
    whole = plan.whole
    sent = suffixes.sparkSession.sparkContext.broadcast(top)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpack(s, p, sent.value) for s, p in zip(table["size"].to_pylist(), table["suffixes"].to_pylist())]
        h1, h2, h3 = (np.concatenate([p[0][i] for p in parts]) for i in range(3))
        counts = np.concatenate([p[1] for p in parts])
        del parts
        needed = least if key[0].as_py() < whole else 1
        c1, v1 = pd.factorize(h1)
        c2, v2 = pd.factorize(h2)
        node, found = pd.factorize(c1 * v2.size + c2)
        total = np.bincount(node, counts).astype(np.int64)  # exact: far below 2**53
        on = (total[node] >= needed) & (h2 != 0)
        frequent = (total >= needed) & (v2[found % v2.size] != 0)
        pairs = found[frequent]
        # Only branches that go on and occur often enough have a third level.
        on &= h3 != 0
        c3, v3 = pd.factorize(h3[on])
        leaf, leaves = pd.factorize(node[on] * max(1, v3.size) + c3)
        leaf_total = np.bincount(leaf, counts[on]).astype(np.int64)
        often = leaf_total >= least
        leaves, leaf_total = leaves[often], leaf_total[often]
        above = found[leaves // max(1, v3.size)]
        none = np.zeros(pairs.size, np.uint64)
        return pa.table({
            "h1": np.concatenate([v1[pairs // v2.size], v1[above // v2.size]]).view(np.int64),
            "h2": np.concatenate([v2[pairs % v2.size], v2[above % v2.size]]).view(np.int64),
            "h3": np.concatenate([none, v3[leaves % max(1, v3.size)]]).view(np.int64),
            "f": np.concatenate([total[frequent], leaf_total]),
        })

    return suffixes.groupBy("grp").applyInArrow(build, "h1 bigint, h2 bigint, h3 bigint, f bigint")


def _score(left: str) -> str:
    """Exact: 38 digits hold a million times the square of 10**15."""
    wide = lambda c: f"cast({c} AS decimal(16,0))"
    return f"(cast(1000000 AS decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({left})"


def mine_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000, cover: int = 50, budget: int = 1 << 19,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words.

    Words are runs without spaces and tabs inside pieces between ``.,;:!?`` and line ends, with A-Z in lower case.
    ``a`` is how often the phrase occurs, at least ``least`` times; its score is the least, over its cuts in two, of
    the integer part of ``1000000 * a * a / (l * r)``, with ``l`` and ``r`` the occurrences of the parts; of equal
    cuts the first counts. ``n`` is all words of the language. A phrase is left out if a longer candidate holds it
    and occurs at least ``cover`` percent as often. Equal scores: more occurrences, then the lesser bytes.

    A null text is empty, a null language is ``und``; every row of a repeated document counts; empty tables give
    no row. Other columns, whatever their names, are not read. ``budget`` bounds the suffixes of a group, and so
    the memory of the task that builds its subtree; it doesn't change the result.
    """
    docs = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    words = materialize(count_words(docs, "text", "lang"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    plan = plan_groups(docs, words, "text", "lang", budget)
    frequent = frequent_words(words)
    codes = np.concatenate([np.zeros(1, np.uint64), frequent, np.zeros(_ESCAPED - frequent.size, np.uint64)])
    grams = materialize(count_phrases(cut_suffixes(docs, plan, codes, "text", "lang"), plan, codes, least))

    known = words.filter(F.col("n") >= least)
    pairs = grams.filter("h3 = 0").groupBy("h1", "h2").agg(F.sum("f").alias("a")).filter(F.col("a") >= least)
    triples = grams.filter("h3 <> 0").select("h1", "h2", "h3", F.col("f").alias("a"))
    held = triples.select(F.explode(F.array(F.struct("h1", "h2", "a"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))).alias("x"))
    held = held.select("x.*").groupBy("h1", "h2").agg(F.max("a").alias("longer"))

    one = lambda h, n: known.select(F.col("h").alias(h), F.col("n").alias(n))
    named = known.select(F.col("h").alias("h1"), F.col("n").alias("n1"), "lang")
    wide = lambda c: f"cast({c} AS decimal(16,0))"
    of_two = pairs.join(held, ["h1", "h2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    of_two = of_two.join(named, "h1").join(one("h2", "n2"), "h2").select(
        "lang", "h1", "h2", F.lit(0).cast("bigint").alias("h3"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"),
        F.expr(_score(f"{wide('n1')} * {wide('n2')}")).alias("score"),
    )
    head, tail = pairs.withColumnRenamed("a", "head"), pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("tail"))
    cuts = triples.join(head, ["h1", "h2"]).join(tail, ["h2", "h3"]).join(named, "h1").join(one("h3", "n3"), "h3").withColumns({
        "_1": F.expr(_score(f"{wide('n1')} * {wide('tail')}")), "_2": F.expr(_score(f"{wide('head')} * {wide('n3')}")),
    })
    early = F.col("_1") <= F.col("_2")
    of_three = cuts.select(
        "lang", "h1", "h2", "h3", "a", F.when(early, F.col("n1")).otherwise(F.col("head")).alias("l"),
        F.when(early, F.col("tail")).otherwise(F.col("n3")).alias("r"), F.when(early, F.col("_1")).otherwise(F.col("_2")).alias("score"),
    )
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties stay until the phrases can be compared.
    leading = materialize(of_two.unionByName(of_three).withColumn("_place", F.rank().over(best)).filter(F.col("_place") <= top))
    for i in (1, 2, 3):
        leading = leading.join(known.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}")), f"h{i}", "left")
    phrases = leading.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return phrases.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
