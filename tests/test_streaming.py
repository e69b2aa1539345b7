"""Streams over several ordered files against their batch operators."""

from datetime import datetime, timedelta

import numpy as np
from bar_rows import BAR, minute_rows
from pyspark.sql import functions as F

from tapeweave.operators import catalysts as cat
from tapeweave.operators.bars import ticks_to_bars
from tapeweave.operators.fusion import catalyst_boost
from tapeweave.sources.tables import BarTable
from tapeweave.streaming import jobs

FAR = datetime(2100, 1, 1)


def land(spark, df, path, files=3):
    """Rows as time-ordered files, one micro-batch each."""
    rows = df.orderBy("ts").collect()
    for part in np.array_split(np.arange(len(rows)), files):
        spark.createDataFrame([rows[i] for i in part], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, tmp_path, name):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ck").outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(out)
    return got.withColumn("ts", F.col("ts").cast("timestamp_ntz")).filter(F.col("ts") < F.lit(FAR).cast("timestamp_ntz"))


def ticks(spark):
    rows = [(r[0], r[1], i, r[5], r[6]) for i, r in enumerate(minute_rows())]
    return spark.createDataFrame(rows + [("END", FAR, 0, 1.0, 1.0)], "symbol string, ts timestamp_ntz, seq long, price double, size double")


def test_bars(spark, tmp_path):
    df = ticks(spark)
    got = run(spark, jobs.bars_stream(land(spark, df, str(tmp_path / "t")), "15 minutes"), tmp_path, "o").orderBy("ts").collect()
    want = ticks_to_bars(df.filter("symbol <> 'END'"), "15m").orderBy("ts").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_late_ticks_are_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    stream = land(spark, ticks(spark).filter("symbol <> 'END'"), path)
    late = spark.createDataFrame([("AAA", datetime(2024, 6, 3, 14), 0, 9999.0, 1.0), ("END", FAR, 0, 1.0, 1.0)], stream.schema)
    late.coalesce(1).write.mode("append").parquet(path)
    got = run(spark, jobs.bars_stream(stream, "15 minutes"), tmp_path, "o")
    assert got.agg(F.max("high")).first()[0] < 9999


def test_dedup(spark, tmp_path):
    rows = [(datetime(2024, 6, 3) + timedelta(minutes=i % 20), "A", f"h{i % 20}", str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, headline string, body string")
    got = run(spark, jobs.dedup_stream(land(spark, df, str(tmp_path / "n"))), tmp_path, "o")
    assert got.count() == 20


def test_boost(spark, tmp_path):
    rng = np.random.default_rng(2)
    t = lambda n: [datetime(2024, 6, 3) + timedelta(minutes=int(m)) for m in np.sort(rng.choice(3000, n, replace=False))]
    sig = spark.createDataFrame([("A", x) for x in t(80)] + [("END", FAR)], "symbol string, ts timestamp_ntz")
    news = spark.createDataFrame(
        [("A", x, "earnings", float(w), 0.5) for x, w in zip(t(60), rng.random(60))] + [("END", FAR, "earnings", 1.0, 1.0)],
        "symbol string, ts timestamp_ntz, catalyst string, strength double, confidence double",
    )
    stream = jobs.boost_stream(land(spark, sig, str(tmp_path / "s")), land(spark, news, str(tmp_path / "c")), 3600, salts=3)
    got = {r["ts"]: r["catalyst_boost"] for r in run(spark, stream, tmp_path, "o").collect()}
    want = catalyst_boost(sig.withColumn("direction", F.lit(1)), news, 3600).filter("symbol = 'A'").collect()
    assert len(got) == 80 and all(abs(got[r["ts"]] - r["catalyst_boost"]) < 1e-12 for r in want)


def test_tags(spark, tmp_path):
    rows = [(datetime(2024, 6, 3, i), "A", h, "", "", "") for i, h in enumerate(["merger", "nothing", "new patent"])]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, headline string, body string, source string, url string")
    got = run(spark, jobs.catalyst_stream(land(spark, df, str(tmp_path / "n"))), tmp_path, "o").orderBy("ts").collect()
    assert [r["catalyst"] for r in got] == [r["catalyst"] for r in cat.tag_keywords(df).orderBy("ts").collect()]


def test_load_in_two_runs(spark, tmp_path):
    rows, path = minute_rows(), str(tmp_path / "landed")
    df = lambda part: spark.createDataFrame(part, BAR).withColumn("timeframe", F.lit("1m"))
    table = BarTable(spark, str(tmp_path / "bars"))
    start = lambda: jobs.load_stream(
        spark.readStream.schema(df(rows).schema).option("maxFilesPerTrigger", 1).parquet(path), table, str(tmp_path / "ck")
    ).awaitTermination()
    df(rows[:200]).coalesce(2).write.mode("append").parquet(path)
    start()
    assert table.read().count() == 200
    df(rows[150:]).coalesce(1).write.mode("append").parquet(path)
    start()
    got = table.read(ordered=True).collect()
    assert [(r["ts"], r["close"]) for r in got] == [(r[1], r[5]) for r in rows]
