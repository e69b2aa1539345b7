from datetime import datetime, timedelta

import pandas as pd
import pytest
from bar_rows import BAR, minute_rows
from pyspark.sql import functions as F

from tapeweave import schemas
from tapeweave.functions.timeframes import Timeframe, duration, duration_seconds, sort_labels, timeframe_seconds
from tapeweave.operators.bars import close_labeled, fill_missing_bars, resample_bars


def test_timeframes():
    assert Timeframe("5m").seconds == 300 and Timeframe("2w").seconds == 1209600
    assert Timeframe("4h") < Timeframe("1d") and not Timeframe("1d") < Timeframe("4h")
    assert sort_labels(["1d", "5m", "1M", "1h", "45m"]) == ["5m", "45m", "1h", "1d", "1M"]
    for bad in ("5x", "m", "", "5 m", "0m"):
        with pytest.raises(ValueError):
            Timeframe(bad)
    assert duration("30d") == timedelta(days=30) and duration("1W") == timedelta(weeks=1)
    for bad in ("1M", "d", "3y"):
        with pytest.raises(ValueError):
            duration(bad)


def test_timeframe_columns(spark):
    df = spark.createDataFrame([("5m", "30d"), ("1h", "1W"), ("1M", "90m")], "tf string, d string")
    got = df.select(timeframe_seconds(F.col("tf")).alias("a"), duration_seconds(F.col("d")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(300, 2592000), (3600, 604800), (2592000, 5400)]
    with pytest.raises(Exception, match="invalid duration"):
        spark.createDataFrame([("1M",)], "d string").select(duration_seconds(F.col("d"))).collect()


def test_hole_is_filled_and_flagged(spark):
    rows = minute_rows()
    holed = spark.createDataFrame(rows[:5] + rows[8:], BAR)
    got = fill_missing_bars(holed, "1m").orderBy("ts").collect()
    assert len(got) == len(rows)
    assert [i for i, r in enumerate(got) if r["imputed"]] == [5, 6, 7]
    assert all(got[i]["close"] == rows[4][5] == got[i]["open"] and got[i]["volume"] == 0 for i in (5, 6, 7))


def test_no_fill_over_night_and_daily_untouched(spark, minutes):
    assert fill_missing_bars(minutes, "1m").count() == 360
    daily = spark.createDataFrame([r for r in minute_rows()[::120]], BAR)
    got = fill_missing_bars(daily, "1d")
    assert got.count() == 3 and got.filter("imputed").count() == 0


def test_off_grid_and_empty_close(spark):
    t = datetime(2024, 6, 3, 14)
    rows = [
        ("A", t, None, None, None, None, 5.0),
        ("A", t + timedelta(minutes=1), 1.0, 2.0, 0.5, 1.5, 5.0),
        ("A", t + timedelta(minutes=1, seconds=30), 9.0, 9.0, 9.0, 9.0, 9.0),
        ("A", t + timedelta(minutes=2), 3.0, 3.0, 3.0, None, 7.0),
        ("A", t + timedelta(minutes=4), 2.0, 2.0, 2.0, 2.0, 1.0),
    ]
    got = fill_missing_bars(spark.createDataFrame(rows, BAR), "1m").orderBy("ts").collect()
    assert [(r["ts"].minute, r["close"], r["volume"], r["imputed"]) for r in got] == [
        (1, 1.5, 5.0, False), (2, 1.5, 7.0, True), (3, 1.5, 0.0, True), (4, 2.0, 1.0, False),
    ]
    assert got[1]["open"] == got[1]["high"] == 1.5


def test_resample_uses_only_its_interval(spark, minutes):
    got = resample_bars(minutes, "5m").orderBy("ts").collect()
    rows = minute_rows()
    assert got[0]["ts"] == datetime(2024, 6, 3, 14, 5)
    first = rows[:5]
    assert got[0]["open"] == first[0][2] and got[0]["close"] == first[4][5]
    assert got[0]["high"] == max(r[3] for r in first) and got[0]["low"] == min(r[4] for r in first)
    assert got[0]["volume"] == sum(r[6] for r in first)


@pytest.mark.parametrize("label,rule", [
    ("15m", "15min"), ("1h", "1h"), ("7h", "7h"), ("1d", "1D"), ("2d", "2D"), ("1w", "1W"), ("2w", "2W"), ("1M", "1MS"), ("3M", "3MS"),
])
def test_resample_matches_pandas(spark, label, rule):
    times = [datetime(2023, 11, 28, 5, 30) + timedelta(hours=11 * i) for i in range(300)]
    rows = [("A", t, float(i), float(i), float(i), float(i), 1.0) for i, t in enumerate(times)]
    got = resample_bars(spark.createDataFrame(rows, BAR), label).orderBy("ts").collect()
    frame = pd.DataFrame({"close": range(300)}, index=pd.DatetimeIndex(times))
    want = frame["close"].resample(rule, label="left", closed="left").last().dropna()
    want.index = want.index + pd.tseries.frequencies.to_offset(rule)
    assert [(r["ts"], r["close"]) for r in got] == [(t.to_pydatetime(), float(c)) for t, c in want.items()]


@pytest.mark.parametrize("label,rule", [("5m", "5min"), ("1w", "1W"), ("2w", "2W"), ("1M", "1MS"), ("2M", "2MS")])
def test_close_label_matches_pandas(spark, label, rule):
    times = [datetime(2024, 1, 1, 3) + timedelta(days=i) for i in range(70)] + [datetime(2024, 3, 1), datetime(2024, 3, 3)]
    rows = [("A", t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in times]
    got = close_labeled(spark.createDataFrame(rows, BAR).withColumn("at", F.col("ts")), label).collect()
    offset = pd.tseries.frequencies.to_offset(rule)
    assert all(r["ts"] == (pd.Timestamp(r["at"]) + offset).to_pydatetime() for r in got)


def test_canonical_bars(spark):
    raw = spark.createDataFrame(
        [("2024-06-03T14:00:00Z", "1", "2", "0", "1", "5", 1), ("2024-06-03 14:00:00", "9", "9", "9", "9", "9", 2),
         ("2024-06-03T16:01:00+02:00", "1", "1", "1", "1", "1", 1)],
        "Date string, Open string, HIGH string, low string, Close string, Volume string, n int",
    )
    got = schemas.canonical_bars(raw, [], "n").orderBy("ts").collect()
    assert [(r["ts"], r["open"]) for r in got] == [(datetime(2024, 6, 3, 14), 9.0), (datetime(2024, 6, 3, 14, 1), 1.0)]
    with pytest.raises(ValueError, match="missing"):
        schemas.canonical_bars(raw.drop("low"), [])
    with pytest.raises(ValueError, match="time"):
        schemas.canonical_bars(raw.drop("Date"), [])


def test_validation(spark):
    t = datetime(2024, 6, 3)
    df = spark.createDataFrame([("A", t, 1.0, 1.0, 1.0, 1.0, 1.0), ("A", t, None, 1.0, -1.0, 1.0, 1.0)], BAR)
    good, bad = schemas.split_valid(df)
    assert good.count() == 1 and bad.first()["violations"] == ["open_null", "low_negative"]
    with pytest.raises(ValueError):
        schemas.validate_bars(df, strict=True)
    assert schemas.empty_bars(spark).count() == 0 and schemas.empty_bars(spark).columns[2:] == ["ts", *schemas.PRICE_COLUMNS]
