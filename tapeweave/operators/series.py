"""Row-exact blocks of long series.

Indicators look a fixed number of *rows* back (and labels a fixed number forward), across gaps of
any length. ``with_row_index`` numbers the rows of every series; ``row_blocks`` then cuts a series
into blocks of equal row count and copies the needed rows of the neighbouring blocks in as a halo,
so that every window of the block is complete. All later windows partition by (series, block):
one shuffle, and no task ever holds more than one block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.operators.scan import block_scan, time_block

BLOCK_ROWS = 65536
INDEX = "_i"


def with_row_index(
    df: DataFrame, keys: list[str] = ["symbol"], ts: str = "ts", span_seconds: int = 4096 * 3600
) -> DataFrame:
    """Number the rows of each series from 0 in time order; times must be unique per series.

    ``span_seconds`` bounds one counting block; pass a bar length times the rows one task may sort.
    """
    out = block_scan(df, keys, [ts], [time_block(ts, span_seconds)], {INDEX: ("count", F.lit(1))})
    return out.withColumn(INDEX, F.col(INDEX) - 1)


@dataclass(frozen=True)
class Blocks:
    """A frame cut into row blocks. ``own`` rows belong to the block, the others are halo."""

    df: DataFrame
    keys: tuple[str, ...]
    sub_rows: int
    rows_each: int

    def window(self):
        return Window.partitionBy(*self.keys, "_blk").orderBy("_sub", INDEX)

    def rows(self, first: int, last: int):
        return self.window().rowsBetween(first, last)

    def sub_window(self):
        """Windows over one sub-block; same shuffle and same sort as ``window``."""
        return Window.partitionBy(*self.keys, "_blk", "_sub").orderBy(INDEX)

    def with_df(self, df: DataFrame) -> "Blocks":
        return Blocks(df, self.keys, self.sub_rows, self.rows_each)

    def columns(self, cols: dict[str, Column]) -> "Blocks":
        return self.with_df(self.df.withColumns(cols)) if cols else self

    def own(self) -> DataFrame:
        """The block's own rows, without helper columns (the row index stays)."""
        kept = self.df.filter(F.col("_own"))
        return kept.drop(*[c for c in kept.columns if c.startswith("_") and c != INDEX])


def row_blocks(
    df: DataFrame,
    keys: list[str] = ["symbol"],
    back: int = 0,
    ahead: int = 0,
    rows: int = BLOCK_ROWS,
    sub_rows: int = 2048,
) -> Blocks:
    """Cut an indexed frame into blocks of ``rows`` rows with halos of ``back`` and ``ahead`` rows."""
    while rows < 2 * max(back, ahead) or rows % sub_rows:
        rows = (max(rows, 2 * max(back, ahead)) // sub_rows + 1) * sub_rows
    block = F.floor(F.col(INDEX) / rows)
    place = F.pmod(F.col(INDEX), F.lit(rows))
    homes = [block]
    if back:
        homes.append(F.when(place >= rows - back, block + 1))
    if ahead:
        homes.append(F.when((place < ahead) & (block > 0), block - 1))
    blocks = F.explode(F.array_compact(F.array(*homes))) if len(homes) > 1 else block
    out = (
        df.withColumn("_blk", blocks)
        .withColumn("_own", F.col("_blk") == block)
        .withColumn("_sub", F.floor(F.col(INDEX) / sub_rows))
        .repartition(*keys, "_blk")
    )
    return Blocks(out, tuple(keys), sub_rows, rows)
