"""CSV files with line ends inside quotes, read in as many tasks as their size asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.operators.scan import block_scan
from tapeweave.session import materialize


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, record, text): the records of CSV files, numbered from 1 in each file, with their inner line ends.

    Files are read as lines, in byte ranges. A line starts a record if the quotes before it in its file are even in
    number; doubled quotes inside a field don't change that. The quotes of a byte range are added up on their own,
    one sum per range is carried across the file, and so are the numbers of the records, so a record that spans
    lines or ranges is put together by its number alone. Lines end with ``\\n`` or ``\\r\\n``.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"),
    )
    # Stored, as a line's number has to stay with it.
    lines = materialize(lines.withColumn("quotes", (F.length("text") - F.length(F.replace("text", F.lit(quote)))).cast("bigint")))
    order, ranges = ["range", "line"], [F.col("range")]
    opened = materialize(block_scan(lines, ["file"], order, ranges, {"before": ("sum", F.col("quotes"))}, inclusive=False))
    starts = (F.coalesce("before", F.lit(0)) % 2 == 0).cast("bigint")
    numbered = block_scan(opened, ["file"], order, ranges, {"record": ("sum", starts)})
    whole = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("range", "line", "text"))).alias("parts"))
    return whole.select("file", "record", F.regexp_replace(F.array_join("parts.text", "\n"), "\r$", "").alias("text"))


def read_quoted_csv(spark: SparkSession, path: str, quote: str = '"', escape: str = '"') -> DataFrame:
    """All columns, as text, of CSV files that share the header of their first record; empty fields are NULL.

    Records that don't have the header's number of fields are filled with NULL or cut, as Spark's reader does.
    """
    records = csv_records(spark, path, quote)
    first = records.filter("record = 1").select("text").orderBy("file").first()
    options = {"quote": quote, "escape": escape, "multiLine": "true"}
    if first is None:
        return spark.createDataFrame([], T.StructType([]))
    head = spark.range(1).select(F.lit(first["text"]).alias("text"))
    numbered = _ddl([f"c{i}" for i in range(first["text"].count(",") + 1)])
    names = [n for n in head.select(F.from_csv("text", numbered, options).alias("r")).first()["r"] if n is not None]
    return records.filter("record > 1 AND text <> ''").select(F.from_csv("text", _ddl(names), options).alias("r")).select("r.*")


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
