"""Partitioned Parquet tables with idempotent upserts, for bars and for news."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.schemas import BAR_SCHEMA, NEWS_SCHEMA, canonical_bars, canonical_news
from tapeweave.session import child_names, drop_path, materialize, path_exists, stage, touch_path


def merge_upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored and incoming rows merged by key, the incoming row winning.

    Adds ``change``: ``inserted``, ``updated`` or ``kept``. Copies of a key collapse before the
    shuffle. ``incoming`` may hold an ``arrival`` column that orders copies among themselves; without it the last
    in the frame's order wins.
    """
    arrival = F.col("arrival") if "arrival" in incoming.columns else F.monotonically_increasing_id()
    columns = stored.columns
    rest = [c for c in columns if c not in keys]
    both = stored.select(*columns, F.lit(0).alias("_new"), F.lit(0).cast("long").alias("_arrival")).unionByName(
        incoming.select(*columns, F.lit(1).alias("_new"), arrival.cast("long").alias("_arrival"))
    )
    # Rows are ordered by a hash of their values, so each travels once.
    merged = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("_new", "_arrival", F.xxhash64(*rest).alias("_hash"))).alias("_row"),
        F.min("_new").alias("_least"),
        F.max("_new").alias("_most"),
    )
    change = F.when(F.col("_least") == 1, "inserted").when(F.col("_most") == 1, "updated").otherwise("kept")
    return merged.select(*keys, "_row.*", change.alias("change")).select(*columns, "change")


def month_predicate(start: datetime | None, end: datetime | None):
    """Partition filter on ``year`` and ``month`` for ``[start, end)``."""
    test = F.lit(True)
    if start is not None:
        test = test & ((F.col("year") > start.year) | ((F.col("year") == start.year) & (F.col("month") >= start.month)))
    if end is not None:
        test = test & ((F.col("year") < end.year) | ((F.col("year") == end.year) & (F.col("month") <= end.month)))
    return test


def range_filter(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Rows of the half-open range, with both ends optional."""
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return df


#: Up to so many values become a partition filter; more are left to the join with the manifest.
FEW = 100


def _few(df: DataFrame, column: str) -> Column:
    """A filter on a partition column's values, if there are few."""
    values = [r[0] for r in df.select(column).distinct().limit(FEW + 1).collect()]
    return F.col(column).isin(values) if len(values) <= FEW else F.lit(True)


class Table:
    """A Parquet table of month folders, read by range and written by upserts that commit as a whole.

    ``data/commit=<n>/<series>/year=/month=`` holds the month folders that commit n wrote; a folder is never changed.
    ``_commits/<n>`` holds the manifest: for every month of every series the commit whose folder is live, its
    rows and its first and last time, and it counts once it holds the mark ``_DONE``. The greatest marked number
    is the table. So a write that is cut off anywhere before its mark has changed nothing, and one that is cut
    off after it has changed everything. All of it lies in the table's own folder. One writer at a time; readers
    keep what they have opened until the commit after next.
    """

    schema: T.StructType
    series: list[str]
    keys: list[str]

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def partitions(self) -> list[str]:
        return [*self.series, "year", "month"]

    def _folder(self, number: int) -> str:
        return f"{self.root}/_commits/{number}"

    def _numbers(self) -> list[int]:
        """Numbers of all commits, also of those without a mark."""
        begun = [n.removeprefix("commit=") for n in child_names(self.spark, f"{self.root}/data")]
        return sorted({int(n) for n in [*begun, *child_names(self.spark, f"{self.root}/_commits")] if n.isdigit()})

    def version(self) -> int:
        """The number of the last whole commit, 0 for none."""
        return next((n for n in reversed(self._numbers()) if path_exists(self.spark, f"{self._folder(n)}/_DONE")), 0)

    def exists(self) -> bool:
        return self.version() > 0

    @property
    def _manifest_schema(self) -> T.StructType:
        columns = [*[self.schema[c] for c in self.series], *T.StructType.fromDDL("year int, month int").fields]
        counts = "commit bigint, n_rows bigint, min_ts timestamp_ntz, max_ts timestamp_ntz, inserted bigint, updated bigint"
        return T.StructType([*columns, *T.StructType.fromDDL(counts).fields])

    def manifest(self, number: int | None = None) -> DataFrame:
        """A row per live month of a series, of the last commit or of a given one."""
        number = self.version() if number is None else number
        if not number:
            return self.spark.createDataFrame([], self._manifest_schema)
        return self.spark.read.schema(self._manifest_schema).parquet(f"{self._folder(number)}/parts")

    def _rows(self, live: DataFrame) -> DataFrame:
        """The rows of the months in ``live``, with their partition columns."""
        full = T.StructType([*self.schema.fields, *T.StructType.fromDDL("commit bigint, year int, month int").fields])
        if not path_exists(self.spark, f"{self.root}/data"):
            return self.spark.createDataFrame([], full).drop("commit")
        stored = self.spark.read.schema(full).parquet(f"{self.root}/data").filter(_few(live, "commit"))
        whole = [*self.partitions, "commit"]
        return stored.join(live.select(*whole), whole, "left_semi").drop("commit")

    def scan(self) -> DataFrame:
        """All rows with their partition columns, under the declared schema."""
        return self._rows(self.manifest())

    def read(
        self, symbols: list[str] | None = None, start: datetime | None = None, end: datetime | None = None,
        columns: list[str] | None = None, ordered: bool = False,
    ) -> DataFrame:
        """Rows of ``[start, end)``; folders outside the range or of other symbols are not opened."""
        wanted = month_predicate(start, end)
        if symbols is not None:
            wanted = wanted & F.col("symbol").isin(symbols)
        df = self._rows(self.manifest().filter(wanted)).filter(wanted)
        df = range_filter(df, start, end).select(*self.schema.names)
        df = df.select("ts", *[c for c in columns if c != "ts"]) if columns else df
        return df.orderBy("ts") if ordered else df

    def coverage(self) -> DataFrame:
        """First and last time and row count of every series, from the manifest alone."""
        return self.manifest().groupBy(*self.series).agg(
            F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.sum("n_rows").alias("n_rows")
        )

    def symbols(self) -> DataFrame:
        """The stored symbols in order, from the manifest alone."""
        return self.manifest().select("symbol").distinct().orderBy("symbol")

    def canonical(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _reached(self, step: str) -> None:
        """Called after each step of an upsert; a test cuts it off here."""

    def upsert(self, df: DataFrame) -> DataFrame:
        """Merge rows by key, the new row winning, and report what changed per series.

        Only the months that receive rows are read, and written anew under the next commit's number; the manifest
        names them beside the months that stay, and its mark ends the commit. Doing it again changes nothing.
        """
        current, number = self.version(), max(self._numbers(), default=0) + 1
        incoming, incoming_path = stage(self.canonical(df).withColumns({"year": F.year("ts"), "month": F.month("ts")}))
        self._reached("staged")
        self._write(self._merged(incoming, self.manifest(current)), number)
        self._reached("written")
        self._publish(current, number)
        self._reached("listed")
        touch_path(self.spark, f"{self._folder(number)}/_DONE")
        self._reached("committed")
        self._clean(number, current)
        drop_path(self.spark, incoming_path)
        return self.changes(number)

    def changes(self, number: int) -> DataFrame:
        """(series, inserted, updated, total) of a commit: total counts the rows of the months it wrote."""
        return self.manifest(number).filter(F.col("commit") == number).groupBy(*self.series).agg(
            F.sum("inserted").alias("inserted"), F.sum("updated").alias("updated"), F.sum("n_rows").alias("total")
        )

    def _merged(self, incoming: DataFrame, manifest: DataFrame) -> DataFrame:
        """Incoming rows merged with those of the months they go to."""
        touched = materialize(incoming.select(*self.partitions).distinct())
        live = manifest.join(touched, self.partitions, "left_semi")
        near = _few(touched, "symbol") & _few(touched, "year") & _few(touched, "month")
        return merge_upsert(self._rows(live.filter(near)).filter(near), incoming, self.keys)

    def _write(self, merged: DataFrame, number: int) -> None:
        columns = ["commit", *self.partitions]
        (
            # Rebalanced by folder: small folders share a task, a folder that is too big is split.
            merged.withColumn("commit", F.lit(number).cast("bigint"))
            .hint("rebalance", *[F.col(c) for c in columns])
            .sortWithinPartitions(*columns, "ts")
            .write.mode("append").partitionBy(*columns).parquet(f"{self.root}/data")
        )

    def _publish(self, current: int, number: int) -> None:
        """The manifest of the new commit, still without its mark: its own months counted, the others carried over."""
        parts = f"{self._folder(number)}/parts"
        written = f"{self.root}/data/commit={number}"
        old = self.manifest(current)
        if path_exists(self.spark, written):
            full = T.StructType([*self.schema.fields, *T.StructType.fromDDL("change string, year int, month int").fields])
            fresh = self.spark.read.schema(full).parquet(written).groupBy(*self.partitions).agg(
                F.lit(number).cast("bigint").alias("commit"), F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
                F.count_if(F.col("change") == "inserted").alias("inserted"), F.count_if(F.col("change") == "updated").alias("updated"),
            )
            fresh = materialize(fresh)
            old = old.join(fresh.select(*self.partitions), self.partitions, "left_anti").select(*self._manifest_schema.names)
            old = old.unionByName(fresh)
        old.write.mode("overwrite").parquet(parts)

    def _clean(self, number: int, previous: int) -> None:
        """Drop the folders that neither this commit nor the one before it reads."""
        used = {r[0] for n in (number, previous) if n for r in self.manifest(n).select("commit").distinct().collect()}
        for n in self._numbers():
            if n not in used and n != number:
                drop_path(self.spark, f"{self.root}/data/commit={n}")
            if n not in (number, previous):
                drop_path(self.spark, self._folder(n))


class BarTable(Table):
    schema = BAR_SCHEMA
    series = ["symbol", "timeframe"]
    keys = ["symbol", "timeframe", "ts"]

    def canonical(self, df: DataFrame) -> DataFrame:
        arrival = "arrival" if "arrival" in df.columns else None
        return canonical_bars(df, self.series, arrival).select(*self.schema.names)

    def read(self, symbols=None, timeframe: str | None = None, start=None, end=None, columns=None, ordered=False):
        df = super().read(symbols, start, end, None, ordered=False)
        df = df.filter(F.col("timeframe") == timeframe) if timeframe else df
        df = df.select("symbol", "ts", *[c for c in columns if c not in ("ts", "symbol")]) if columns else df
        return df.orderBy("symbol", "ts") if ordered else df


class NewsTable(Table):
    schema = NEWS_SCHEMA
    series = ["symbol"]
    keys = ["symbol", "ts", "headline"]

    def canonical(self, df: DataFrame) -> DataFrame:
        return canonical_news(df)
