"""Point-in-time joins: the latest row at or before a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.operators.scan import block_scan, time_block

DAY = 86400


def asof_join(
    left: DataFrame,
    rights: dict[str, DataFrame],
    keys: list[str] = ["symbol"],
    ts: str = "ts",
    block_seconds: int = DAY,
) -> DataFrame:
    """Attach to each left row the last row of every right frame with ``ts`` at or before its own.

    ``rights`` maps a suffix to a frame; its columns come out as ``column_suffix``. Right times
    must be unique per key. All frames are stacked and scanned once, so one shuffle serves any
    number of right frames, no pair of rows is ever formed, and a long series is cut into time
    blocks of ``block_seconds``; blocks without any right row carry on the last one before them. The
    left frame is read a second time for its keys and times alone, the right ones twice in full.
    """
    payload = {s: [c for c in r.columns if c not in (*keys, ts)] for s, r in rights.items()}
    types = {
        s: F.struct(*payload[s]) for s in rights
    }
    empty = {}
    for s, right in rights.items():
        schema = right.select(types[s].alias("s")).schema["s"].dataType
        empty[s] = F.lit(None).cast(schema)
    others = [c for c in left.columns if c not in (*keys, ts)]

    stacked = left.select(
        *keys, ts, *others, *[empty[s].alias(f"_row_{s}") for s in rights], F.lit(1).alias("_side")
    )
    for s, right in rights.items():
        stacked = stacked.unionByName(
            right.select(
                *keys, ts,
                *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in others],
                *[(types[s] if s == r else empty[r]).alias(f"_row_{r}") for r in rights],
                # Right rows first on equal times: an exact match is visible.
                F.lit(0).alias("_side"),
            )
        )
    found = block_scan(
        stacked, keys, [ts, "_side"], [time_block(ts, block_seconds)],
        {f"_hit_{s}": ("last", F.col(f"_row_{s}")) for s in rights},
        givers=F.col("_side") == 0,
    ).filter(F.col("_side") == 1)
    return found.select(
        *left.columns,
        *[F.col(f"_hit_{s}")[c].alias(f"{c}_{s}") for s in rights for c in payload[s]],
    )
