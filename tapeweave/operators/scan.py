"""Running aggregates along an ordered series, cut into blocks.

A running sum over one long series is a serial walk if it is written as one window. Here the
series is cut into blocks of the order axis (time spans, row blocks): each block is scanned on its
own, a small table with one total per block is scanned across blocks, and the result is carried
into the rows. So a series that holds a third of all rows spreads over as many tasks as it has
blocks, and the only per-series step runs on the block totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.arith import col
from tapeweave.session import materialize


def _running(fn: str, value: Column, frame) -> Column:
    if fn == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[fn](value).over(frame)


def _total(fn: str, value: Column, order: list[Column]) -> Column:
    if fn == "last":
        position = F.struct(*order) if len(order) > 1 else order[0]
        return F.max_by(value, F.when(value.isNotNull(), position))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[fn](value)


def _across(fn: str) -> str:
    """The aggregate that joins block totals."""
    return "sum" if fn == "count" else fn


def _merge(fn: str, carried: Column, local: Column) -> Column:
    if fn == "count":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if fn == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if fn == "max":
        return F.greatest(carried, local)
    if fn == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def block_scan(
    df: DataFrame,
    keys: list[str],
    order: list,
    blocks: list[Column],
    scans: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    givers: Column | None = None,
) -> DataFrame:
    """Add running ``sum``, ``count``, ``max``, ``min`` or ``last`` (non-null) columns.

    ``keys``      columns of the series; may be empty for one global order
    ``order``     columns that order rows totally within a series
    ``blocks``    block expressions, coarse to fine; each must follow the order
    ``scans``     output name -> (aggregate, value)
    ``inclusive`` whether a row's own value counts
    ``givers``    which rows have values at all, if not all; only these are aggregated for the block totals

    ``df`` is read twice, for the rows and for the totals: pass a stored frame if it is costly.
    """
    # Names tell the level: the scan across blocks is itself a scan over fewer blocks.
    names = [f"_block{len(blocks)}_{i}" for i in range(len(blocks))]
    order = [col(c) for c in order]
    # Values get names of their own: an output may replace a column the scan still reads.
    values = {out: (fn, f"_value_{out}") for out, (fn, _) in scans.items()}
    base = df.withColumns(
        dict(zip(names, blocks)) | {f"_value_{out}": col(value) for out, (_, value) in scans.items()}
    )

    frame = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = base.withColumns({f"_local_{o}": _running(fn, F.col(v), frame) for o, (fn, v) in values.items()})

    totals = (base if givers is None else base.filter(givers)).groupBy(*keys, *names).agg(
        *[_total(fn, F.col(v), order).alias(f"_carry_{o}") for o, (fn, v) in values.items()]
    )
    if givers is not None:
        # A block without givers carries on what the blocks before it gave, so it needs a row too.
        totals = base.select(*keys, *names).distinct().join(totals, [*keys, *names], "left")
    carry_scans = {f"_carry_{o}": (_across(fn), F.col(f"_carry_{o}")) for o, (fn, _) in values.items()}
    if len(blocks) == 1:
        before = Window.partitionBy(*keys).orderBy(names[0]).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.withColumns({o: _running(fn, v, before) for o, (fn, v) in carry_scans.items()})
    else:
        # One more level: block totals are scanned within the next coarser blocks.
        coarse = [F.col(n) for n in names[:-1]]
        carried = block_scan(totals, keys, names, coarse, carry_scans, inclusive=False).select(
            *keys, *names, *carry_scans
        )

    # Series keys may be NULL-free by contract; block columns are computed and never NULL.
    out = local.join(carried, [*keys, *names], "left")
    merged = {o: _merge(fn, F.col(f"_carry_{o}"), F.col(f"_local_{o}")) for o, (fn, _) in values.items()}
    drop = names + [f"{p}_{o}" for o in values for p in ("_local", "_carry", "_value")]
    return out.withColumns(merged).drop(*drop)


def range_blocks(df: DataFrame, order: list[str], out: str = "_range") -> DataFrame:
    """The rows dealt out by ranges of the whole order, with the number of their range.

    For orders over all series: one moment, such as the close of a day, may hold rows of every symbol, and
    the full order key splits it where time blocks cannot. The ranges are even, since keys do not repeat; the
    rows are stored, as the number has to stay with them.
    """
    return materialize(df.repartitionByRange(*[col(c) for c in order]).withColumn(out, F.spark_partition_id()))


def time_block(ts, seconds: int) -> Column:
    """Number of the time span of the given length that holds ``ts``."""
    from tapeweave.functions.timeframes import epoch_seconds

    return F.floor(epoch_seconds(col(ts)) / seconds)
