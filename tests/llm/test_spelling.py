"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeweave.llm.spelling import group_spellings, near_words

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(rows, fold=97, least_len=5, least_n=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % fold == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= least_n and len(w) >= least_len}


def brute(rows, **options):
    n = vocabulary(rows, **options)
    forms, out = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(found), n[best] if forms[w] else None)
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return sorted((w, forms[w], root(w), *out[w]) for w in n)


def grouped(df, **options):
    return sorted(tuple(r) for r in group_spellings(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("fold", [97, 3])
def test_equals_all_pairs(spark, fold):
    rng = random.Random(fold)
    pool = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 9))) for _ in range(30)]
    while len(pool) < 150:  # edits of words, and edits of those
        w = rng.choice(pool[-40:])
        at = rng.randrange(len(w))
        pool.append(w[:at] + rng.choice(["", "c", "é" + w[at]]) + w[at + 1 :])
    rows = []
    for i in range(120):
        words = rng.choices(pool, [1 / (k + 1) for k in range(150)], k=60)
        rows.append((i if i % 9 else None, " ".join(w.upper() if rng.random() < 0.1 else w for w in words).replace(" a", "×a", 1)))
    rows += [(7, None), (8, ""), (9, " 123 ÷ \n"), (9, "日本語 abÀéÿ abÀéÿ abÀéÿ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, fold=fold)
    assert len(want) > 60 and sum(r[4] for r in want) > 40 and any(r[2] not in (r[0], r[1]) for r in want)
    assert grouped(df, fold=fold) == want


def test_near_words_of_all_lengths(spark):
    """Every place and kind of edit, in short words and in words whose trie takes several code points a level."""
    rng = random.Random(5)
    words = set()
    for size in (5, 6, 7, 12, 63, 64, 65, 66, 127, 128, 129, 130, 300, 1000):
        base = "".join(rng.choice("abc") for _ in range(size))
        words.add(base)
        for at in {0, 1, size // 2 - 1, size // 2, size // 2 + 1, size - 2, size - 1, *(rng.randrange(size) for _ in range(4))}:
            words |= {base[:at] + base[at + 1 :], base[:at] + "z" + base[at + 1 :], base[:at] + "z" + base[at:], base[:at] + base[at] + base[at:]}
        words |= {base + "a", "a" + base}
    words = sorted(words)
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = sorted(tuple(r) for r in near_words(df).collect())
    assert got == sorted((a, b) for a in words for b in words if near(a, b))


def test_corners(spark, corner_docs, no_docs):
    rows = [tuple(r) for r in corner_docs.select("doc_id", "text").collect()]
    clash = corner_docs.withColumn("word", F.lit("x")).withColumn("n", F.lit(9)).withColumn("node", F.lit(1))
    assert grouped(clash) == brute(rows)
    assert grouped(no_docs) == []
    assert grouped(no_docs.union(corner_docs.filter("text IS NULL").select(no_docs.columns))) == []
