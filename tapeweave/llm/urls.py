"""URL filters: rules and a block list as Bloom filter cascades that are exact over the keys of a corpus."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.session import materialize

# The rules (verdict, host, path), and the blocked host labels.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def host_labels(host: Column) -> Column:
    return F.split(host, r"\.")


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key under which a rule may list this URL: host suffixes by label, each with the path's prefixes."""
    labels = host_labels(host)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull()
    )
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


@dataclass
class Level:
    words: list[int]
    salt: int
    hashes: int

    def holds(self, key: Column) -> Column:
        """Whether all bits of the key are set. The bits are a literal: they go out with the plan, once a level."""
        bits = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        return F.forall(
            F.array(*self.spots(key)),
            lambda p: F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1,
        )

    def spots(self, key: Column) -> list[Column]:
        size = 64 * len(self.words) if self.words else self.size
        return [F.pmod(F.xxhash64(key, F.lit(self.salt * 64 + i)), F.lit(size).cast("bigint")) for i in range(self.hashes)]

    size: int = 64


@dataclass
class Cascade:
    """Levels in turn hold listed keys, unlisted keys the level before lets through, listed keys of those, and so on."""

    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        # Past the last level, the answer is what that level stands for.
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].holds(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


class TooLarge(ValueError):
    """A filter that is not to be sent to every task."""


def _encode(keys: DataFrame, n: int, salt: int, bits_per_key: int, hashes: int, max_bits: int) -> Level:
    size = 1 << max(6, math.ceil(math.log2(max(1, n) * bits_per_key)))
    if size > max_bits:
        raise TooLarge(f"{n} keys need a filter of {size} bits; max_bits allows {max_bits}")
    level = Level([], salt, hashes, size)
    spots = keys.select(F.explode(F.array(*level.spots(F.col("key")))).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("bits")
    )
    # At most max_bits / 64 rows.
    dense = [0] * (size // 64)
    for word, bits in words.collect():
        dense[word] = bits
    level.words = dense
    return level


def build_cascade(
    listed: DataFrame, universe: DataFrame, bits_per_key: int = 8, hashes: int = 4, max_bits: int = 1 << 24, max_levels: int = 64,
) -> Cascade:
    """Filters that tell the keys of ``listed`` from all other keys of ``universe`` without error.

    Both frames have one column ``key``; nulls and repeats are dropped. The first level has a hash for every
    doubling of the universe against the list, so that about as many other keys as listed ones pass it, however
    large the universe; the levels after it shrink by a few hundredths of the other side each. So what every task
    receives grows with the list and the logarithm of the universe. A filter beyond ``max_bits`` raises
    ``TooLarge``; more than ``max_levels`` would mean that hashes of listed and other keys agree, and raise.
    """
    listed = materialize(listed.filter(F.col("key").isNotNull()).distinct())
    outside = materialize(universe.filter(F.col("key").isNotNull()).join(listed, "key", "left_anti").distinct())
    inside, n = listed, listed.count()
    doublings = math.ceil(math.log2(max(1.0, math.sqrt(2) * outside.count() / max(1, n))))
    first = max(hashes, doublings)
    levels: list[Level] = []
    while len(levels) < max_levels:
        shape = (bits_per_key, hashes) if levels else (max(bits_per_key, math.ceil(first / math.log(2))), first)
        level = _encode(inside, n, len(levels), *shape, max_bits)
        levels.append(level)
        through = materialize(outside.filter(level.holds(F.col("key"))))
        n = through.count()
        if not n:
            return Cascade(levels)
        inside, outside = through, inside
    raise RuntimeError("the cascade does not end: the hashes of listed and other keys agree")


def filter_urls(
    pages: DataFrame, url: str = "url", rules: tuple = RULES, blocked: tuple | DataFrame = BLOCKED_LABELS, **sizes,
) -> DataFrame:
    """Adds host, path, rule, verdict and listed to every row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins (of equal
    ones the greater string). Where none fits, the block list decides: ``block`` if a label of the host is
    listed (``listed``), else ``allow``. Rules are looked up as keys, host suffix and path prefix together,
    in one cascade per verdict; labels in a third. The cascades are built over all keys that occur in
    ``pages``, so membership is exact and the pages meet no join. Only a block list whose filter would pass
    ``max_bits`` is joined instead, by the labels of the distinct hosts; the result is the same.

    Null URLs and those without ``://`` have empty host and path, no rule, and ``allow``. Columns of
    ``pages`` that are named like the added ones are replaced. Empty input gives no rows.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    parts = pages.select(host.alias("_h"), path.alias("_p")).distinct()
    lengths = sorted({len(p) for _, _, p in rules})
    universe = materialize(parts.select(F.explode(rule_keys(F.col("_h"), F.col("_p"), lengths)).alias("key")).distinct())
    labels = materialize(parts.select(F.explode(host_labels(F.col("_h"))).alias("key")).distinct())

    def keys(values) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], "key string")

    by_verdict = {
        v: build_cascade(keys([h + p for w, h, p in rules if w == v]), universe, **sizes) for v in ("allow", "block")
    }
    named = blocked if isinstance(blocked, DataFrame) else keys(blocked)
    try:
        block_list = build_cascade(named, labels, **sizes)
        is_listed = F.exists(host_labels(F.col("host")), lambda x: block_list.contains(x))
        judged = pages.withColumns({"host": host, "path": path})
    except TooLarge:
        hosts = parts.select(F.col("_h").alias("host"), F.explode(host_labels(F.col("_h"))).alias("key")).distinct()
        hit = hosts.join(named.select("key").distinct(), "key", "left_semi").select("host", F.lit(True).alias("_hit")).distinct()
        is_listed = F.coalesce("_hit", F.lit(False))
        judged = pages.withColumns({"host": host, "path": path}).join(hit, "host", "left").select(*dict.fromkeys([*pages.columns, "host", "path"]), "_hit")
    hits = F.transform(
        rule_keys(F.col("host"), F.col("path"), lengths),
        lambda k: F.struct(
            F.length(k).alias("n"), k.alias("rule"),
            F.when(by_verdict["block"].contains(k), "block").when(by_verdict["allow"].contains(k), "allow").alias("verdict"),
        ),
    )
    best = F.array_max(F.filter(hits, lambda x: x["verdict"].isNotNull()))
    return (
        judged.withColumns({"_best": best, "listed": is_listed})
        .withColumns({
            "rule": F.col("_best.rule"),
            "verdict": F.coalesce(F.col("_best.verdict"), F.when(F.col("listed"), "block").otherwise("allow")),
        })
        .drop("_best", "_hit")
    )
