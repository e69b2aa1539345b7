"""Table schemas, canonical forms and row rules for bars and news."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]
# Accepted names of the time column, in order of preference.
TIME_COLUMNS = ["ts", "timestamp", "date", "datetime", "time"]

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("timeframe", T.StringType()),
     T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS]
)
NEWS_SCHEMA = T.StructType(
    [T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in ["symbol", "headline", "body", "source", "url"]]
)


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BAR_SCHEMA)


def empty_news(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NEWS_SCHEMA)


def utc_ntz(col):
    """Any timestamp, date or ISO text as a UTC wall-clock timestamp; bad text becomes NULL."""
    return F.to_utc_timestamp(F.try_to_timestamp(col.cast("string")), F.current_timezone()).cast("timestamp_ntz")


def keep_last(df: DataFrame, keys: list[str], arrival) -> DataFrame:
    """One row per key, the one that arrived last; equal arrivals are settled by a hash of the row.

    An aggregate rather than a ranked window: copies of one key collapse on the map side,
    so a key that holds a third of all rows never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(arrival, F.xxhash64(*rest))).alias("_kept"))
        .select(*[F.col(k) for k in keys], "_kept.*")
        .select(*df.columns)
    )


def canonical_bars(df: DataFrame, keys: list[str] | None = None, arrival: str | None = None) -> DataFrame:
    """Bars with canonical names and types, one per key and time (the last to arrive).

    Column names match in any letter case. ``arrival`` names the column that orders duplicates; it must make the
    order total among rows of one key and time. Without it the frame's own order counts, as its partitions come:
    of a file's rows the last stays.
    """
    by_lower = {c.lower(): c for c in df.columns}
    time_name = next((by_lower[c] for c in TIME_COLUMNS if c in by_lower), None)
    if time_name is None:
        raise ValueError("no time column found")
    missing = [c for c in PRICE_COLUMNS if c not in by_lower]
    if missing:
        raise ValueError(f"missing bar columns: {missing}")
    keys = keys if keys is not None else [c for c in ("symbol", "timeframe") if c in by_lower]
    if df.schema[time_name].dataType == T.TimestampNTZType():
        ts = F.col(time_name)
    elif df.schema[time_name].dataType == T.TimestampType():
        ts = F.to_utc_timestamp(F.col(time_name), F.current_timezone()).cast("timestamp_ntz")
    else:
        ts = utc_ntz(F.col(time_name))
    out = df.select(
        *[F.col(by_lower.get(k, k)).alias(k) for k in keys],
        ts.alias("ts"),
        *[F.col(by_lower[c]).cast("double").alias(c) for c in PRICE_COLUMNS],
        (F.col(arrival) if arrival else F.monotonically_increasing_id()).alias("_arrival"),
    )
    return keep_last(out, keys + ["ts"], F.col("_arrival")).drop("_arrival")


def violations(columns: list[str] = PRICE_COLUMNS):
    """Array of the rules a bar breaks: every price and volume present and not negative."""
    rules = [F.when(F.col(c).isNull() | F.isnan(c), F.lit(f"{c}_null")) for c in columns]
    rules += [F.when(F.col(c) < 0, F.lit(f"{c}_negative")) for c in columns]
    return F.array_compact(F.array(*rules))


def validate_bars(df: DataFrame, strict: bool = False) -> DataFrame:
    """Bars with a ``violations`` array; in strict mode any broken rule raises."""
    out = df.withColumn("violations", violations())
    if strict and not out.filter(F.size("violations") > 0).isEmpty():
        raise ValueError("bars break the price rules")
    return out


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) bars."""
    checked = validate_bars(df)
    return (
        checked.filter(F.size("violations") == 0).drop("violations"),
        checked.filter(F.size("violations") > 0),
    )


def canonical_news(df: DataFrame) -> DataFrame:
    """The six news columns; missing body, source and url become empty text.

    An ``arrival`` column, if there is one, stays: it tells which copy of a story came last.
    """
    have = set(df.columns)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    ts = F.col("ts") if df.schema["ts"].dataType == T.TimestampNTZType() else F.to_utc_timestamp(
        F.col("ts").cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return df.select(
        ts.alias("ts"), F.col("symbol").cast("string").alias("symbol"),
        F.col("headline").cast("string").alias("headline"),
        blank("body").alias("body"), blank("source").alias("source"), blank("url").alias("url"),
        *(["arrival"] if "arrival" in have else []),
    )
