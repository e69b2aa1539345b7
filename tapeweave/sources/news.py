"""News from CSV files and from JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.functions.text import json_time
from tapeweave.schemas import canonical_news
from tapeweave.sources.csv import read_quoted_csv
from tapeweave.sources.tables import range_filter


def read_news_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """News from CSV files with a header: timestamp, symbol, headline and optionally body, source, url.

    Times without an offset are UTC; a malformed time raises. ``multi_line`` allows line ends inside quoted
    fields; such a file is split like any other.
    """
    raw = read_quoted_csv(spark, path) if multi_line else spark.read.option("header", True).option("escape", '"').csv(path)
    at = F.to_timestamp(F.col("timestamp"))
    ts = F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz")
    return canonical_news(raw.withColumn("ts", ts))


def news_slice(news: DataFrame, symbol: str, start=None, end=None) -> DataFrame:
    """One symbol's news of ``[start, end)``."""
    return range_filter(news.filter(F.col("symbol") == symbol), start, end)


# Nested values are read as text: their shape differs between payloads.
_FIELDS = (
    "title string, summary string, description string, pubDate string, displayTime string, "
    "provider string, canonicalUrl string, clickThroughUrl string"
)
PAYLOAD_SCHEMA = (
    f"struct<{_FIELDS.replace(' string', ': string')}, publisher: string, link: string, "
    f"providerPublishTime: string, content: struct<{_FIELDS.replace(' string', ': string')}>>"
)


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def news_from_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """News from JSON payloads, flat or with the fields nested under ``content``.

    Each payload is parsed once. Payloads without a title or a readable time drop out.
    """
    # Generated rows are a barrier: the later filter does not parse the text a second time.
    parsed = payloads.select("*", F.explode(F.array(F.from_json(F.col(payload), PAYLOAD_SCHEMA))).alias("_p"))
    top, inner = F.col("_p"), F.col("_p.content")
    nested = inner.isNotNull()
    field = lambda name: F.when(nested, inner[name]).otherwise(top[name])
    is_object = lambda c: F.coalesce(F.startswith(c, F.lit("{")), F.lit(False))

    provider = field("provider")
    source = F.when(is_object(provider), F.get_json_object(provider, "$.displayName")).otherwise(top["publisher"])
    filled = lambda name: F.nullif(_text(field(name)), F.lit("{}"))
    link = F.coalesce(filled("canonicalUrl"), filled("clickThroughUrl"))
    url = F.when(is_object(link), F.get_json_object(link, "$.url")).otherwise(top["link"])
    return parsed.select(
        json_time(top["providerPublishTime"], F.coalesce(_text(field("pubDate")), _text(field("displayTime")))).alias("ts"),
        "symbol",
        F.coalesce(_text(field("title")), _text(top["title"])).alias("headline"),
        F.coalesce(_text(field("summary")), _text(field("description")), F.lit("")).alias("body"),
        F.coalesce(source, F.lit("")).alias("source"),
        F.coalesce(url, F.lit("")).alias("url"),
    ).filter(F.col("headline").isNotNull() & F.col("ts").isNotNull())
