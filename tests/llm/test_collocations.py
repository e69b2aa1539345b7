"""Phrase collocations against counts of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tapeweave.llm.collocations import mine_phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top, cover=50):
    """rows of (text, lang) -> set of result rows."""
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for part in {p[:2], p[1:]} if len(p) == 3 else ():
                longer[part] = max(longer[part], a)
        rows = []
        for p, a in candidates.items():
            if len(p) == 2 and 100 * longer[p] >= cover * a:
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], score))
        rows.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (p, a, l, r, s) in enumerate(rows[:top])]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in mine_phrases(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(seed, n, words):
    rng = random.Random(seed)
    pool = [rng.choice("abcdeé") * rng.randint(1, 3) + rng.choice(["", "x", "Y", "ß"]) for _ in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [
        " ".join(rng.choices(pool, weights)[0] + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(n)
    ]


@pytest.mark.parametrize("budget", [1 << 20, 700, 40])
def test_equals_counts_of_all_phrases(spark, budget):
    """The smallest budget deals prefixes of two and of three words to groups."""
    rows = [(t, lang) for i, lang in enumerate(["en", "de", None, "und"]) for t in prose(i, 80, 30)]
    rows += [(None, "en"), ("", None), ("the the the the the the", "fr"), ("a a a. a a a a a a a a a a a a", "fr")] * 3
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert mined(df, least=6, top=25, budget=budget) == brute(rows, 6, 25)


def test_ties_go_by_bytes_of_the_phrase(spark):
    pairs = [(f"{x}q {x}r", "en") for x in "dcbaéz"] * 4
    df = spark.createDataFrame(pairs, "text string, lang string")
    got = mined(df, least=4, top=5)
    assert got == brute(pairs, 4, 5) and [r[2] for r in got] == ["aq ar", "bq br", "cq cr", "dq dr", "zq zr"]


def test_corners(spark, corner_docs, no_docs):
    rows = [(r["text"], r["lang"]) for r in corner_docs.select("text", "lang").collect()]
    assert mined(corner_docs, least=2, top=50, budget=5000) == brute(rows, 2, 50)
    clash = corner_docs.withColumn("h", F.lit("x")).withColumn("n", F.lit("y")).withColumn("a", F.lit(1))
    assert mined(clash, least=2, top=50) == brute(rows, 2, 50)
    assert mined(no_docs) == []
    empty = spark.createDataFrame([(None, None), ("", "en"), (" \n. ", "en")], "text string, lang string")
    assert mined(empty, least=1) == []
