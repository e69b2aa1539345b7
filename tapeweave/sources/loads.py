"""Incremental loads: plans of time chunks, resume points, load and report."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.functions.timeframes import duration, epoch_micros
from tapeweave.schemas import PRICE_COLUMNS, violations
from tapeweave.session import materialize, path_exists
from tapeweave.sources.tables import Table

# How far back each timeframe is loaded, and for any other.
HISTORY = {"1m": "30d", "5m": "60d", "15m": "60d", "1h": "730d", "1d": "3650d"}
OTHER_HISTORY = "365d"


def _micros(length: timedelta) -> int:
    return length // timedelta(microseconds=1)


def _interval(length: timedelta) -> Column:
    return F.expr(f"INTERVAL '{length // timedelta(seconds=1)}' SECOND")


def series_plan(symbols: DataFrame, timeframes: list[str], end: Column, history: dict[str, str] = HISTORY) -> DataFrame:
    """(symbol, timeframe, start, end): the history window of every series."""
    windows = F.array(*[
        F.struct(F.lit(tf).alias("timeframe"), (end - _interval(duration(history.get(tf, OTHER_HISTORY)))).alias("start"))
        for tf in timeframes
    ])
    return symbols.select("symbol", F.inline(windows)).withColumn("end", end)


def resume_plan(plan: DataFrame, coverage: DataFrame, series: list[str] = ["symbol", "timeframe"]) -> DataFrame:
    """Plan with ``start`` moved past the last stored time, where that is not before the start."""
    known = coverage.select(*series, "max_ts")
    after = F.col("max_ts") + F.expr("INTERVAL '1' SECOND")
    start = F.when(F.col("max_ts") >= F.col("start"), after).otherwise(F.col("start"))
    return plan.join(known, series, "left").withColumn("start", start).drop("max_ts")


def chunk_plan(plan: DataFrame, chunk: str = "1W") -> DataFrame:
    """Plan cut into windows ``[lo, hi)`` of one chunk; the last may be short."""
    length = duration(chunk)
    starts = F.when(
        F.col("start") < F.col("end"),
        F.sequence("start", F.col("end") - F.expr("INTERVAL '0.000001' SECOND"), _interval(length)),
    )
    rest = [c for c in plan.columns if c not in ("start", "end")]
    return plan.select(*rest, "end", F.posexplode(starts).alias("chunk", "lo")).select(
        *rest, "chunk", "lo", F.least(F.col("lo") + _interval(length), F.col("end")).alias("hi")
    )


def planned_rows(source: DataFrame, plan: DataFrame, series: list[str], chunk: str = "1W") -> DataFrame:
    """Source rows inside their series' window, with the number of their chunk.

    The chunk follows from the distance to the start, so the join is on the series alone.
    """
    late = epoch_micros(F.col("ts")) - epoch_micros(F.col("start"))
    return (
        source.join(plan.select(*series, "start", "end"), series)
        .filter((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
        .withColumn("chunk", F.floor(late / F.lit(_micros(duration(chunk)))))
        .drop("start", "end")
    )


def load_report(source: DataFrame, plan: DataFrame, series: list[str], chunk: str = "1W") -> DataFrame:
    """Per series: window, number of chunks, rows found, and chunks that held rows."""
    found = planned_rows(source, plan, series, chunk).groupBy(*series, "chunk").agg(F.count(F.lit(1)).alias("n"))
    per_series = found.groupBy(*series).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("filled_chunks"))
    length = F.lit(_micros(duration(chunk)))
    span = F.greatest(epoch_micros(F.col("end")) - epoch_micros(F.col("start")), F.lit(0))
    return plan.join(per_series, series, "left").select(
        *series, "start", "end", F.ceil(span / length).cast("long").alias("chunks"),
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("filled_chunks", F.lit(0)).alias("filled_chunks"),
    )


def broken_rules(table: Table) -> Column:
    """Why a row can't be stored: a null key, or for bars a broken price rule; empty for a good row."""
    rules = [F.when(F.col(k).isNull(), F.lit(f"{k}_null")) for k in table.keys]
    bars = violations() if set(PRICE_COLUMNS) <= set(table.schema.names) else F.array().cast("array<string>")
    return F.concat(F.array_compact(F.array(*rules)), bars)


def ledger(table: Table) -> DataFrame:
    """(load, series, chunk, lo, hi, n_rows, rejected, state, error) of every chunk that a load has begun, by series.

    ``state`` is ``done`` if the chunk's commit took place, and else ``failed``; the last load's word on a chunk is
    the one with the greatest ``at``.
    """
    rows = table.spark.read.schema(_ledger_schema(table)).parquet(f"{table.root}/_loads") if path_exists(table.spark, f"{table.root}/_loads") else None
    return table.spark.createDataFrame([], _ledger_schema(table)) if rows is None else rows


def rejects(table: Table) -> DataFrame:
    """The rows that loads have not stored, with their chunk, the load and the rules they break."""
    path, schema = f"{table.root}/_rejects", T.StructType([*table.schema.fields, *T.StructType.fromDDL("load string, chunk bigint, violations array<string>").fields])
    return table.spark.read.schema(schema).parquet(path) if path_exists(table.spark, path) else table.spark.createDataFrame([], schema)


def _ledger_schema(table: Table) -> T.StructType:
    rest = "chunk bigint, lo timestamp_ntz, hi timestamp_ntz, n_rows bigint, rejected bigint, inserted bigint, updated bigint, state string, error string, load string, at timestamp_ntz"
    return T.StructType([*[table.schema[c] for c in table.series], *T.StructType.fromDDL(rest).fields])


def load(source: DataFrame, plan: DataFrame, table: Table, chunk: str = "1W", resume: bool = True) -> DataFrame:
    """Load the planned windows of all series into a table, a commit per chunk, and report per series.

    The source is read once: its rows inside the plan are stored with their chunk and split into good ones and
    rejects. Chunk after chunk, the good rows of all series are upserted and the ledger notes each series' chunk
    with its counts and errors; a chunk that fails is noted as such and ends the load with its error. A load that
    is repeated with ``resume`` starts after the last stored time of each series, so it goes on at the chunk that
    failed. The report has (series, start, end, chunks, rows, filled_chunks, inserted, updated, total, rejected,
    error): what the loaded chunks held, and which rules the rejected rows broke.
    """
    spark, series, name = table.spark, table.series, uuid.uuid4().hex
    # The plan reads the table's coverage and has to be fixed before the table changes.
    plan = materialize(resume_plan(plan, table.coverage(), series) if resume else plan)
    rows = materialize(planned_rows(source, plan, series, chunk).withColumn("violations", broken_rules(table)))
    good, bad = rows.filter(F.size("violations") == 0).drop("violations"), rows.filter(F.size("violations") > 0)
    broken = bad.select(*series, "chunk", F.explode("violations").alias("rule")).groupBy(*series, "chunk", "rule").agg(F.count(F.lit(1)).alias("n"))
    errors = broken.groupBy(*series, "chunk").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "rule", F.col("n").cast("string")))), ", ").alias("error")  # one per rule
    )
    sizes = rows.groupBy(*series, "chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("violations") > 0).alias("rejected"))
    windows = chunk_plan(plan.select(*series, "start", "end"), chunk).withColumn("chunk", F.col("chunk").cast("bigint"))
    noted = materialize(windows.join(sizes, [*series, "chunk"], "left").join(errors, [*series, "chunk"], "left").fillna(0, ["n_rows", "rejected"]))
    if not bad.isEmpty():
        bad.select(*table.schema.names, F.lit(name).alias("load"), "chunk", "violations").write.mode("append").parquet(f"{table.root}/_rejects")

    def note(number: int, state: str, error: Column, changed: DataFrame) -> None:
        mine = noted.filter(F.col("chunk") == number).join(changed.select(*series, "inserted", "updated"), series, "left").fillna(0, ["inserted", "updated"])
        mine.select(
            *series, "chunk", "lo", "hi", "n_rows", "rejected", "inserted", "updated", F.lit(state).alias("state"), error.alias("error"),
            F.lit(name).alias("load"), F.localtimestamp().alias("at"),
        ).write.mode("append").parquet(f"{table.root}/_loads")

    nothing = spark.createDataFrame([], T.StructType([*[table.schema[c] for c in series], *T.StructType.fromDDL("inserted bigint, updated bigint").fields]))
    # A number per chunk of the longest window.
    for number in sorted(r["chunk"] for r in noted.filter("n_rows > rejected").select("chunk").distinct().collect()):
        try:
            changed = table.upsert(good.filter(F.col("chunk") == number).drop("chunk"))
        except Exception as why:
            note(number, "failed", F.lit(str(why).splitlines()[0][:300] if str(why) else type(why).__name__), nothing)
            raise
        note(number, "done", F.col("error"), changed)
    done = ledger(table).filter(F.col("load") == name).groupBy(*series).agg(F.sum("inserted").alias("inserted"), F.sum("updated").alias("updated"))
    found = noted.groupBy(*series).agg(
        F.sum("n_rows").alias("rows"), F.count_if(F.col("n_rows") > 0).alias("filled_chunks"), F.count(F.lit(1)).alias("chunks"),
        F.sum("rejected").alias("rejected"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("chunk", "error")))),
                                 lambda e: F.concat(F.lit("chunk "), e["chunk"].cast("string"), F.lit(": "), e["error"])), "; ").alias("error"),
    )
    stored = table.coverage().select(*series, F.col("n_rows").alias("total"))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("chunks", "rows", "filled_chunks", "inserted", "updated", "total", "rejected")]
    return plan.select(*series, "start", "end").join(found, series, "left").join(done, series, "left").join(stored, series, "left").select(
        *series, "start", "end", *counts, F.coalesce("error", F.lit("")).alias("error")
    )


def base_bars(table: Table, symbols: list[str], timeframe: str) -> DataFrame:
    """The bars of several series in one scan; series without rows simply do not appear."""
    return table.read(symbols=symbols, timeframe=timeframe).drop("timeframe")


