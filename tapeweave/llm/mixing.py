"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeweave.session import materialize

#: Words as the sizes count them.
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text):
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str = "source", weights: int = 3, most: int = 3) -> DataFrame:
    """One row per source: source_size, weight, target and the total of all sizes.

    Sources in code point order, null last, weigh 1, 2 .. ``weights`` and again. Together they share all
    words by weight, but none more than ``most`` times its own; the excess goes to the others by weight.
    That is the level at which giving every source ``min(cap, weight * level)`` uses the total: sources are
    taken in the order in which they reach their caps, and the level follows from two running sums. The
    windows hold one row per source, not per document.
    """
    sources = sized.groupBy(F.col(source).alias("_source")).agg(F.sum("size").alias("source_size"))
    by_name = F.col("_source").asc_nulls_last()
    ranked = sources.withColumn("weight", ((F.row_number().over(W.orderBy(by_name)) - 1) % weights + 1).cast("long")).withColumn(
        "_cap", most * F.col("source_size")
    )
    order = W.orderBy(F.col("_cap") / F.col("weight"), by_name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = ranked.select(
        "*",
        F.row_number().over(order).alias("_rank"),
        F.sum("source_size").over(everything).alias("_total"),
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("_level"),
    )
    # The first source that stays below its cap sets the level for all from there on.
    open_ones = F.when(F.col("weight") * F.col("_level") < F.col("_cap"), F.struct("_rank", "_level"))
    first = F.min(open_ones).over(everything)
    return levels.withColumn("_first", first).select(
        "_source", "source_size", "weight", "_total",
        F.when(F.col("_rank") >= F.col("_first._rank"), F.col("weight") * F.col("_first._level"))
        .otherwise(F.col("_cap").cast("double")).alias("target"),
    )


def _cut(copies: DataFrame, total: int, slots: int) -> tuple[float, int, int] | None:
    """Where the running total of words by finish time passes ``total``.

    Two rounds of ``slots`` ranges: (lower end of the range, its scale, words before it); None if it never does.
    """
    before, scale, low = 0, slots, None
    for _ in range(2):
        # Times far behind the cut share the last range.
        tick = F.least(F.floor(F.col("_finish") * scale), F.lit(2 * scale)).cast("long")
        part = copies if low is None else copies.filter(F.floor(F.col("_finish") * (scale // slots)) == low)
        sums = part.groupBy(tick.alias("_tick")).agg(F.sum("size").alias("_words"))
        running = sums.withColumn("_upto", before + F.sum("_words").over(W.orderBy("_tick")))
        passed = running.filter(F.col("_upto") > total).agg(F.min(F.struct("_tick", F.col("_upto") - F.col("_words"))).alias("c"))
        found = passed.first()["c"]
        if found is None:
            return None
        low, before, scale = found[0], found[1], scale * slots
    return low, scale // slots, before


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
    weights: int = 3, most: int = 3, slots: int = 1024, row: str | None = None,
) -> DataFrame:
    """How often the mix takes each document: id, source, size, source_size, target, copies and taken.

    Every source is shuffled by the MD5 of seed and id and may be read ``most`` times in that order. A copy's
    virtual finish time is the source's words up to the copy's end, divided by the source's target, so a
    source that has given its target is at time 1. All copies in order of finish time and source are taken
    while their running total stays within the total of all sizes.

    No window spans a source or the whole order: running sums come from ``slots`` ranges of the shuffle per
    source, and the global cut from two rounds of ``slots`` ranges of finish time; only the last range is
    ordered copy by copy. What reaches the driver is the cut, a few numbers.

    Null and empty texts have size 0 and are never taken; a null source is a source; null ids shuffle like an
    empty one; each repeated row counts. ``row`` names a column that comes out as it is, to find rows again;
    others are not read. Empty input gives no rows.
    """
    extra = [row] if row else []
    sized = materialize(docs.select(
        F.col(id_col).alias("_id"), F.col(source).alias("_source"), text_size(F.col(text)).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_key"), *extra,
    ))
    targets = materialize(source_targets(sized, "_source", weights, most))
    slot = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * slots / F.lit(2.0**32)).cast("int")
    sums = sized.groupBy("_source", slot.alias("_slot")).agg(F.sum("size").alias("_words"))
    earlier = W.partitionBy("_source").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    known = (
        sums.select("_source", "_slot", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
        .join(targets.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")))
        .select("_of", F.col("_slot").alias("_at"), "_before", "source_size", "target", "_total")
    )
    placed = sized.withColumn("_slot", slot)
    inside = W.partitionBy("_source", "_slot").orderBy("_key", "_id", "size").rowsBetween(W.unboundedPreceding, 0)
    ended = materialize(
        placed.withColumn("_end", F.sum("size").over(inside))
        .join(known, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_at")))
        .select("_id", "_source", "size", "source_size", "target", "_total", (F.col("_before") + F.col("_end")).alias("_end"), *extra)
    )
    passes = range(most)
    finish = [(copy * F.col("source_size") + F.col("_end")) / F.col("target") for copy in passes]
    copies = ended.filter("size > 0").select("_source", "size", F.explode(F.array(*finish)).alias("_finish"))
    total = targets.agg(F.max("_total")).first()[0] or 0
    cut = _cut(copies, total, slots)
    if cut is None:
        count = F.lit(most)
    else:
        low, scale, before = cut
        # Finish times of a source rise strictly, so time and source order all copies.
        place = [F.col("_finish"), F.col("_source").isNull().alias("none"), F.coalesce("_source", F.lit("")).alias("source")]
        last = (
            copies.filter(F.floor(F.col("_finish") * scale) == low)
            .withColumn("_place", F.struct(*place))
            .withColumn("_upto", before + F.sum("size").over(W.orderBy("_place").rowsBetween(W.unboundedPreceding, 0)))
            .filter(F.col("_upto") <= total)
            .agg(F.max("_place").alias("p"))
            .first()["p"]
        )
        # Up to the last copy taken, or up to the range if it takes none of its copies.
        end = F.struct(
            F.lit(last[0] if last else low / scale).alias("_finish"), F.lit(last[1] if last else False).alias("none"),
            F.lit(last[2] if last else "").alias("source"),
        )
        count = sum(
            (F.struct(f.alias("_finish"), *place[1:]) <= end if last else f < end["_finish"]).cast("long") for f in finish
        )
    taken = F.when(F.col("size") > 0, count).otherwise(0).cast("long")
    return ended.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source), "size", "source_size", "target", taken.alias("copies"),
        (F.col("size") * taken).alias("taken"), *extra,
    )
