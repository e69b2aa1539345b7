import json
import os
import re
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from bar_rows import BAR, minute_rows
from pyspark.sql import functions as F

from tapeweave.operators import catalysts as cat
from tapeweave.schemas import canonical_news, empty_news
from tapeweave.sources import loads
from tapeweave.sources.news import news_from_json, news_slice, read_news_csv
from tapeweave.sources.tables import BarTable, NewsTable

NEWS = "ts timestamp_ntz, symbol string, headline string, body string, source string, url string"
JUNE, JULY = datetime(2024, 6, 28, 12), datetime(2024, 7, 2, 9)


def bars(spark, rows=None, timeframe="1m"):
    return spark.createDataFrame(rows or minute_rows(), BAR).withColumn("timeframe", F.lit(timeframe))


def data_filters(plan):
    """The partition filters of the scan of a table's rows: the one that knows commits as a partition."""
    return next(f for f in re.findall(r"PartitionFilters: \[(.*?)\]", plan) if "commit" in f)


def test_round_trip_and_range(spark, tmp_path):
    table = BarTable(spark, str(tmp_path / "bars"))
    assert table.read().count() == 0 and table.coverage().count() == 0
    table.upsert(bars(spark))
    got = table.read(["AAA"], "1m", ordered=True).collect()
    rows = minute_rows()
    assert [(r["ts"], r["close"]) for r in got] == [(r[1], r[5]) for r in rows]
    cut = table.read(["AAA"], "1m", rows[10][1], rows[20][1], ["close"], ordered=True)
    assert cut.count() == 10 and cut.columns == ["symbol", "ts", "close"]
    c = table.coverage().first()
    assert (c["min_ts"], c["max_ts"], c["n_rows"]) == (rows[0][1], rows[-1][1], 360)
    assert [r[0] for r in table.symbols().collect()] == ["AAA"]
    assert (tmp_path / "bars" / "data" / "commit=1" / "symbol=AAA" / "timeframe=1m" / "year=2024" / "month=6").is_dir()


def test_upsert_is_idempotent_and_last_wins(spark, tmp_path):
    table = BarTable(spark, str(tmp_path / "bars"))
    first = table.upsert(bars(spark)).first()
    assert (first["inserted"], first["updated"], first["total"]) == (360, 0, 360)
    again = table.upsert(bars(spark)).first()
    assert (again["inserted"], again["updated"], again["total"]) == (0, 360, 360)
    changed = bars(spark, [(s, t, 1.0, 1.0, 1.0, 1.0, 1.0) for s, t, *_ in minute_rows()[:5]])
    table.upsert(changed)
    got = table.read(ordered=True).collect()
    assert len(got) == 360 and [r["close"] for r in got[:5]] == [1.0] * 5 and got[5]["close"] != 1.0


def test_upsert_leaves_other_months_alone(spark, tmp_path):
    table = BarTable(spark, str(tmp_path / "bars"))
    later = [(s, t + timedelta(days=40), *x) for s, t, *x in minute_rows()]
    table.upsert(bars(spark, minute_rows() + later))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("month=6/*.parquet")}
    table.upsert(bars(spark, later[:3]))
    assert files and {p: p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("month=6/*.parquet")} == files
    assert table.read().count() == 720


def test_upsert_reads_only_its_months_and_symbols(spark, tmp_path):
    table = BarTable(spark, str(tmp_path / "bars"))
    later = [(s, t + timedelta(days=40), *x) for s, t, *x in minute_rows()]
    table.upsert(bars(spark, minute_rows() + later + [("BBB", t, *x) for _, t, *x in later]))
    incoming = bars(spark, later[:3]).withColumns({"year": F.year("ts"), "month": F.month("ts")})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = table._merged(incoming, table.manifest())._jdf.queryExecution().executedPlan().toString()
    filters = data_filters(plan)
    assert "AAA" in filters and "2024" in filters and "BBB" not in filters and "month" in filters
    table.upsert(bars(spark, later[:3]))
    assert sorted(p.parent.name for p in (tmp_path / "bars" / "data" / "commit=2").rglob("*.parquet")) == ["month=7"]


CUT = """
import os, sys
sys.path[:0] = [{repo!r}, {tests!r}]
from datetime import timedelta
from pyspark.sql import functions as F
from bar_rows import BAR, minute_rows
from tapeweave.session import local_session
from tapeweave.sources.tables import BarTable

class Cut(BarTable):
    def _reached(self, step):
        if step == {step!r}:
            os._exit(9)

spark = local_session(2, "cut", shuffle_partitions=2)
rows = [(s, t + timedelta(days=d), 1.0, 1.0, 1.0, 1.0, 1.0) for d in (0, 40) for s, t, *_ in minute_rows()[:5]]
Cut(spark, {root!r}).upsert(spark.createDataFrame(rows, BAR).withColumn("timeframe", F.lit("1m")))
"""


@pytest.mark.parametrize("step", ["staged", "written", "listed", "committed"])
def test_a_write_killed_between_steps_is_all_or_nothing(spark, tmp_path, step):
    """Another process writes and is killed; this one opens the table, and goes on with it."""
    root = str(tmp_path / "bars")
    table = BarTable(spark, root)
    table.upsert(bars(spark))
    here = os.path.dirname(os.path.abspath(__file__))
    code = CUT.format(repo=os.path.dirname(here), tests=here, step=step, root=root)
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=300).returncode == 9
    closes = lambda: [r["close"] for r in table.read(ordered=True).collect()]
    whole = step == "committed"
    assert len(closes()) == (365 if whole else 360) and closes()[:5] == ([1.0] * 5 if whole else [r[5] for r in minute_rows()[:5]])
    assert table.coverage().first()["n_rows"] == len(closes())
    changed = bars(spark, [(s, t, 2.0, 2.0, 2.0, 2.0, 2.0) for s, t, *_ in minute_rows()[:2]])
    report = table.upsert(changed).first()
    assert (report["inserted"], report["updated"], report["total"]) == (0, 2, 360)
    assert closes()[:5] == [2.0, 2.0, *([1.0] * 3 if whole else [r[5] for r in minute_rows()[2:5]])]
    kept = {p.name for p in (tmp_path / "bars" / "data").glob("commit=*")}
    assert kept == {f"commit={r[0]}" for n in (table.version(), 2 if whole else 1) for r in table.manifest(n).select("commit").collect()}


def test_coverage_reads_no_rows(spark, tmp_path):
    table = BarTable(spark, str(tmp_path / "bars"))
    table.upsert(bars(spark))
    for df in (table.coverage(), table.symbols()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "_commits" in plan and "/data" not in plan


def test_partition_filters_reach_the_scan(spark, tmp_path, capsys):
    table = BarTable(spark, str(tmp_path / "bars"))
    table.upsert(bars(spark))
    table.read(["AAA"], "1m", datetime(2024, 6, 3), datetime(2024, 6, 4), ["close"]).explain()
    plan = capsys.readouterr().out
    filters = data_filters(plan)
    assert "(symbol" in filters and "year" in filters and "commit" in filters
    assert "ReadSchema: struct<ts:timestamp_ntz,close:double>" in plan


def news(spark, *rows):
    return spark.createDataFrame(rows, NEWS)


def test_news_months_dedup_and_range(spark, tmp_path):
    table = NewsTable(spark, str(tmp_path / "news"))
    assert table.read().isEmpty()
    table.upsert(news(spark, (JUNE, "A", "one", "b", "s", "u"), (JULY, "A", "two", None, None, None), (JUNE, "B", "one", "", "", "")))
    table.upsert(news(spark, (JUNE, "A", "one", "newer", "s", "u"), (JUNE, "A", "other", "", "", "")))
    got = table.read(["A"], ordered=True).collect()
    assert len(got) == 3 and {r["body"] for r in got if r["headline"] == "one"} == {"newer"}
    assert next(r for r in got if r["headline"] == "two")["source"] == ""
    assert {p.name for p in (tmp_path / "news" / "data").rglob("symbol=A/year=2024/month=*")} == {"month=6", "month=7"}
    assert table.read(["A"], JULY, JULY + timedelta(days=1)).count() == 1 and table.read(["A"], JUNE, JULY).count() == 2
    cover = {r["symbol"]: (r["min_ts"], r["max_ts"]) for r in table.coverage().collect()}
    assert cover["A"] == (JUNE, JULY)


def test_hot_copies_collapse(spark, tmp_path):
    """A third of all rows are copies of one story."""
    table = NewsTable(spark, str(tmp_path / "news"))
    rows = [(JUNE, "A", "hot", str(i), "", "") for i in range(500)] + [(JUNE, "A", f"h{i}", "", "", "") for i in range(1000)]
    table.upsert(news(spark, *rows).withColumn("arrival", F.coalesce(F.col("body").try_cast("int"), F.lit(0))))
    got = table.read()
    assert got.count() == 1001 and got.filter("headline = 'hot'").first()["body"] == "499"


def plan(spark, start, end, series=("AAA", "1m")):
    return spark.createDataFrame([(*series, start, end)], "symbol string, timeframe string, start timestamp_ntz, end timestamp_ntz")


def test_chunks(spark):
    start = datetime(2024, 6, 3)
    got = loads.chunk_plan(plan(spark, start, start + timedelta(days=2, hours=12)), "1d").orderBy("chunk").collect()
    assert [(r["lo"], r["hi"]) for r in got] == [
        (start, start + timedelta(days=1)), (start + timedelta(days=1), start + timedelta(days=2)),
        (start + timedelta(days=2), start + timedelta(days=2, hours=12)),
    ]
    assert loads.chunk_plan(plan(spark, start, start + timedelta(days=3)), "1d").count() == 3
    assert loads.chunk_plan(plan(spark, start, start), "1d").count() == 0
    with pytest.raises(ValueError):
        loads.chunk_plan(plan(spark, start, start), "1M")


def test_resume(spark):
    start = datetime(2024, 6, 3)
    cover = lambda t: spark.createDataFrame([("AAA", "1m", t)], "symbol string, timeframe string, max_ts timestamp_ntz")
    p = plan(spark, start, start + timedelta(days=3))
    first = lambda t: loads.resume_plan(p, cover(t)).first()["start"]
    assert first(start + timedelta(hours=5)) == start + timedelta(hours=5, seconds=1)
    assert first(start) == start + timedelta(seconds=1) and first(start - timedelta(days=1)) == start


def test_incremental_load(spark, tmp_path):
    source, table = bars(spark), BarTable(spark, str(tmp_path / "bars"))
    start = datetime(2024, 6, 3)
    report = loads.load(source, plan(spark, start, start + timedelta(days=2)), table, "1d").first()
    assert (report["chunks"], report["rows"], report["inserted"], report["filled_chunks"]) == (2, 240, 240, 2)
    report = loads.load(source, plan(spark, start, start + timedelta(days=3)), table, "1d").first()
    assert (report["rows"], report["inserted"], report["updated"]) == (120, 120, 0)
    assert report["start"] == minute_rows()[239][1] + timedelta(seconds=1)
    again = loads.load(source, plan(spark, start, start + timedelta(days=3)), table, "1d").first()
    assert (again["rows"], again["inserted"]) == (0, 0)
    full = loads.load(source, plan(spark, start, start + timedelta(days=3)), table, "1d", resume=False).first()
    assert (full["rows"], full["updated"], full["total"]) == (360, 360, 360)
    assert loads.base_bars(table, ["AAA", "ZZZ"], "1m").count() == 360


def test_a_load_that_fails_goes_on_at_its_chunk(spark, tmp_path, monkeypatch):
    """Chunks of a day; the third commit fails. What was committed stays, the ledger says so, a repeat does the rest."""
    table = BarTable(spark, str(tmp_path / "bars"))
    source = bars(spark, minute_rows(days=5, per_day=20) + [("BBB", *r[1:]) for r in minute_rows(days=2, per_day=20)])
    start = datetime(2024, 6, 3)
    wanted = spark.createDataFrame(
        [(s, "1m", start, start + timedelta(days=5)) for s in ("AAA", "BBB", "CCC")], "symbol string, timeframe string, start timestamp_ntz, end timestamp_ntz"
    )
    written, upsert = [], BarTable.upsert

    def failing(self, df):
        written.append(sorted({r[0].day for r in df.select("ts").collect()}))
        if len(written) == 3:
            raise RuntimeError("the store is full\nand more")
        return upsert(self, df)

    with monkeypatch.context() as m:
        m.setattr(BarTable, "upsert", failing)
        with pytest.raises(RuntimeError, match="full"):
            loads.load(source, wanted, table, "1d")
    assert table.read().count() == 80 and written == [[3], [4], [5]]
    states = {(r["symbol"], r["chunk"]): (r["state"], r["error"], r["inserted"]) for r in loads.ledger(table).collect()}
    assert states["AAA", 1] == ("done", None, 20) and states["AAA", 2] == ("failed", "the store is full", 0) and states["CCC", 0] == ("done", None, 0)
    with monkeypatch.context() as m:
        m.setattr(BarTable, "upsert", lambda self, df: written.append(sorted({r[0].day for r in df.select("ts").collect()})) or upsert(self, df))
        report = {r["symbol"]: r for r in loads.load(source, wanted, table, "1d").collect()}
    assert written[3:] == [[5], [6], [7]]
    assert (report["AAA"]["rows"], report["AAA"]["inserted"], report["AAA"]["total"], report["AAA"]["error"]) == (60, 60, 100, "")
    assert (report["BBB"]["rows"], report["BBB"]["total"]) == (0, 40) and (report["CCC"]["rows"], report["CCC"]["total"], report["CCC"]["chunks"]) == (0, 0, 5)
    assert table.read().count() == 140


def test_rows_that_break_rules_are_kept_aside(spark, tmp_path):
    table = BarTable(spark, str(tmp_path / "bars"))
    rows = minute_rows(days=2, per_day=10)
    spoiled = [(s, t, None if i == 3 else o, h, -1.0 if i in (3, 4, 15) else l, c, v) for i, (s, t, o, h, l, c, v) in enumerate(rows)]
    start = datetime(2024, 6, 3)
    report = loads.load(bars(spark, spoiled), plan(spark, start, start + timedelta(days=2)), table, "1d").first()
    assert (report["rows"], report["rejected"], report["inserted"]) == (20, 3, 17)
    assert report["error"] == "chunk 0: low_negative 2, open_null 1; chunk 1: low_negative 1"
    aside = loads.rejects(table).orderBy("ts").collect()
    assert [r["ts"] for r in aside] == [rows[i][1] for i in (3, 4, 15)] and aside[0]["violations"] == ["open_null", "low_negative"]
    assert table.read().count() == 17


def test_history_windows(spark):
    names = spark.createDataFrame([("A",), ("B",)], "symbol string")
    end = datetime(2024, 6, 30)
    got = loads.series_plan(names, ["1m", "1h", "4h"], F.lit(end).cast("timestamp_ntz")).collect()
    spans = {(r["symbol"], r["timeframe"]): (r["end"] - r["start"]).days for r in got}
    assert len(got) == 6 and spans["A", "1m"] == 30 and spans["B", "1h"] == 730 and spans["A", "4h"] == 365


def test_news_forms(spark, tmp_path):
    df = spark.createDataFrame([(JUNE, "A", "h", None)], "ts timestamp_ntz, symbol string, headline string, body string")
    assert canonical_news(df).first().asDict() == {"ts": JUNE, "symbol": "A", "headline": "h", "body": "", "source": "", "url": ""}
    assert empty_news(spark).columns == ["ts", "symbol", "headline", "body", "source", "url"]
    path = tmp_path / "n.csv"
    path.write_text('timestamp,symbol,headline,source\n2024-06-03 10:00:00,A,"one, two",s\n2024-06-03T12:00:00+02:00,B,"say ""x""",\n')
    got = read_news_csv(spark, str(path)).orderBy("symbol").collect()
    assert [r["ts"] for r in got] == [datetime(2024, 6, 3, 10)] * 2
    assert got[0]["headline"] == "one, two" and got[1]["headline"] == 'say "x"' and got[1]["source"] == "" and got[0]["url"] == ""
    items = news(spark, (JUNE, "A", "x", "", "", ""), (JULY, "A", "y", "", "", ""), (JUNE, "B", "z", "", "", ""))
    assert [r["headline"] for r in news_slice(items, "A", JUNE, JULY).collect()] == ["x"]


@pytest.mark.parametrize("payload,want", [
    ({"title": "T", "publisher": "P", "link": "L", "providerPublishTime": 1717408800}, (datetime(2024, 6, 3, 10), "T", "", "P", "L")),
    ({"content": {"title": "N", "pubDate": "2024-06-03T10:00:00Z", "provider": {"displayName": "D"}, "canonicalUrl": {"url": "U"}, "summary": "S"}},
     (datetime(2024, 6, 3, 10), "N", "S", "D", "U")),
    ({"content": {"title": "N", "displayTime": "2024-06-03T10:00:00Z", "description": "Q", "clickThroughUrl": {"url": "V"}}, "publisher": "P", "link": "L"},
     (datetime(2024, 6, 3, 10), "N", "Q", "P", "V")),
    ({"content": {"title": "", "pubDate": "2024-06-03T10:00:00Z", "provider": {}, "canonicalUrl": {}}, "title": "top", "publisher": "P"},
     (datetime(2024, 6, 3, 10), "top", "", "", "")),
    ({"title": "T"}, None), ({"publisher": "P", "providerPublishTime": 1717408800}, None),
    ({"content": {"title": "N", "pubDate": "not a time"}}, None), ({"content": {"title": "N", "pubDate": ""}}, None),
])
def test_json_payloads(spark, payload, want):
    df = spark.createDataFrame([("A", json.dumps(payload))], "symbol string, payload string")
    got = news_from_json(df).collect()
    assert [tuple(r[c] for c in ("ts", "headline", "body", "source", "url")) for r in got] == ([want] if want else [])


def tag(spark, headline, body="", **options):
    return cat.tag_keywords(news(spark, (JUNE, "A", headline, body, "s", "")), **options).first()


def test_keywords(spark):
    got = tag(spark, "Acme to acquire Beta in takeover")
    assert (got["catalyst"], got["strength"], got["confidence"]) == ("m_and_a", 0.9, pytest.approx(0.8))
    assert tag(spark, "New strategic alliance", "A PARTNERSHIP")["catalyst"] == "partnership"
    assert tag(spark, "FDA approval")["strength"] == 0.7
    none = tag(spark, "Weather today")
    assert (none["catalyst"], none["strength"], none["confidence"]) == ("none", 0.0, 0.0)
    assert tag(spark, "a second later")["catalyst"] == "regulatory"  # found inside a word
    assert tag(spark, "merger and lawsuit")["catalyst"] == "m_and_a"  # first of the lexicon on ties
    assert tag(spark, "acquire acquire")["confidence"] == pytest.approx(0.6)
    many = tag(spark, "acquire acquisition merger takeover buyout")
    assert many["confidence"] == 1.0
    assert cat.actionable_catalysts(cat.tag_keywords(news(spark, (JUNE, "A", "x", "", "", "")))).isEmpty()
    assert tag(spark, "zebra", lexicon={"animal": ["zebra"]})["strength"] == 0.3
    assert tag(spark, "far " * 30000 + "merger")["catalyst"] == "m_and_a"


@pytest.mark.parametrize("label,score,mood,conviction,want", [
    ("merger or acquisition or takeover", 0.9, "positive", 1.0, ("m_and_a", 0.9, 0.9)),
    ("merger or acquisition or takeover", 0.9, "neutral", 0.9, ("m_and_a", 0.45, 0.9)),
    ("quarterly earnings or financial results or guidance", 0.8, "NEGATIVE", 0.5, ("earnings", 0.3, 0.8)),
    ("merger or acquisition or takeover", 0.4, "positive", 1.0, ("none", 0.0, 0.0)),
    ("routine business news with no major catalyst", 0.9, "positive", 1.0, ("none", 0.0, 0.0)),
    ("unknown", 0.9, "positive", 1.0, ("none", 0.0, 0.0)),
])
def test_scored(spark, label, score, mood, conviction, want):
    df = spark.createDataFrame(
        [(JUNE, "A", "s", [label, "x"], [score, 1 - score], mood, conviction)],
        "ts timestamp_ntz, symbol string, source string, labels array<string>, scores array<double>, sentiment_label string, sentiment_score double",
    )
    got = cat.tag_scores(df).first()
    assert (got["catalyst"], got["strength"], got["confidence"]) == want
