"""Domain tables derived from the test tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.functions.timeframes import epoch_micros
from tapeweave.operators.bars import ticks_to_bars
from tapeweave.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(c):
    return c.cast("decimal(38,0)")


def shifted(c, digits: int):
    """Decimal digits moved left, to pack several sort fields into one number."""
    return (wide(c) * F.lit(Decimal(10**digits))).cast("decimal(38,0)")


def ticks(spark: SparkSession, sf_dir: str, symbol=None) -> DataFrame:
    """One price per event; the order of equal times is the event id.

    ``seq`` packs (time, id) into one decimal, a type that hash aggregates can keep in place.
    """
    events = table(spark, sf_dir, "events")
    symbol = F.col("event_type") if symbol is None else symbol
    return events.select(
        symbol.alias("symbol"),
        "ts",
        (shifted(epoch_micros(F.col("ts")), 15) + wide(F.col("event_id"))).cast("decimal(38,0)").alias("seq"),
        (F.col("value") + 1.0).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def bars_1h(spark: SparkSession, sf_dir: str, label: str = "start") -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), "1h", label=label)


def supplier_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price per line item, by supplier and ship date. Times are whole days, so ``seq`` only
    orders the items of a day."""
    lines = table(spark, sf_dir, "lineitem")
    seq = shifted(F.col("l_orderkey") * 10 + F.col("l_linenumber"), 12) + wide(F.col("l_partkey"))
    return lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        seq.cast("decimal(38,0)").alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
    )


def bars_1d(spark: SparkSession, sf_dir: str, label: str = "start") -> DataFrame:
    return ticks_to_bars(supplier_ticks(spark, sf_dir), "1d", label=label)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of hourly bars: what analytics read, instead of all ticks again."""
    return materialize(bars_1h(spark, sf_dir))


def hourly_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, stamped when the bars close."""
    return materialize(bars_1h(spark, sf_dir, label="close"))


def daily_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of the suppliers' daily bars."""
    return materialize(bars_1d(spark, sf_dir, label="close"))


# The symbols of the event ticks, in order.
SYMBOLS = ["click", "error", "purchase", "signup", "view"]


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: the first line is the headline, times spread over 30 days."""
    docs = table(spark, sf_dir, "documents")
    minute = F.pmod(F.col("doc_id") * 7919, F.lit(43200)).cast("int")
    names = F.array(*[F.lit(s) for s in SYMBOLS])
    return docs.select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minute)).alias("ts"),
        F.get(names, F.pmod(F.col("doc_id"), F.lit(5)).cast("int")).alias("symbol"),
        F.substring_index("text", "\n", 1).alias("headline"),
        F.col("text").alias("body"),
        "source",
        F.lit("").alias("url"),
        "doc_id",
        "n_chars",
    )


# A lexicon of letter groups that occur in the invented texts.
LEXICON = {
    "m_and_a": ["anhe", "hethe", "whth"],
    "partnership": ["ionble", "reand"],
    "breakthrough": ["edor", "tionou", "stst"],
    "earnings": ["inging", "orer"],
    "regulatory": ["sec", "ererer"],
}


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News with the output columns of a text model."""
    from tapeweave.operators.catalysts import MODEL_LABELS

    labels = F.array(*[F.lit(x) for x in MODEL_LABELS])
    moods = F.array(F.lit("positive"), F.lit("neutral"), F.lit("Negative"))
    turn = F.pmod(F.col("doc_id"), F.lit(6)).cast("int")
    first = 0.3 + F.pmod(F.col("n_chars"), F.lit(70)) / 100.0
    return news(spark, sf_dir).select(
        "doc_id", "ts", "symbol", "source",
        F.concat(F.slice(labels, turn + 1, 6), F.slice(labels, F.lit(1), turn)).alias("labels"),
        F.array(first, 1.0 - first).alias("scores"),
        F.get(moods, F.pmod(F.col("doc_id"), F.lit(3)).cast("int")).alias("sentiment_label"),
        (F.pmod(F.col("doc_id"), F.lit(101)) / 100.0).alias("sentiment_score"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News as JSON text, flat for even ids and nested for odd ones; some lack a title or a time."""
    n = news(spark, sf_dir)
    keep = lambda test, value: F.when(test, value)
    title = keep(F.pmod("doc_id", F.lit(11)) != 0, F.col("headline"))
    timed = F.pmod("doc_id", F.lit(13)) != 0
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    link = F.concat(F.lit("https://example.org/"), F.col("doc_id"))
    flat = F.to_json(F.struct(
        title.alias("title"), F.col("source").alias("publisher"), link.alias("link"),
        keep(timed, epoch).alias("providerPublishTime"),
    ))
    nested = F.to_json(F.struct(F.struct(
        title.alias("title"), keep(timed, iso).alias("pubDate"), F.col("body").alias("summary"),
        F.struct(F.col("source").alias("displayName")).alias("provider"),
        F.struct(link.alias("url")).alias("canonicalUrl"),
    ).alias("content")))
    return n.select("symbol", F.when(F.pmod("doc_id", F.lit(2)) == 0, flat).otherwise(nested).alias("payload"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(hourly_closed(spark, sf_dir))


def signals_of(bars: DataFrame) -> DataFrame:
    """Signals without a model: momentum gives the side, the distance of RSI from 50 the probability."""
    from tapeweave.operators.indicators import add_indicators

    f = add_indicators(bars, "1h", ["macd_hist", "rsi_14"])
    return f.filter(F.col("macd_hist").isNotNull() & F.col("rsi_14").isNotNull()).select(
        "symbol", "ts",
        F.signum("macd_hist").cast("int").alias("direction"),
        (0.5 + F.least(F.lit(0.49), F.abs(F.col("rsi_14") - 50) / 100)).alias("probability"),
        F.lit(12).alias("horizon"),
    )


def catalysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeweave.operators.catalysts import tag_keywords

    return tag_keywords(news(spark, sf_dir), LEXICON)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and predicted class per labelled document; class 3 is out of range."""
    return table(spark, sf_dir, "labels").select(
        (F.col("quality") + F.col("toxic")).cast("int").alias("label"),
        F.pmod("doc_id", F.lit(4)).cast("int").alias("pred"),
        (F.pmod("doc_id", F.lit(3)) + 1).cast("int").alias("fold"),
    )
