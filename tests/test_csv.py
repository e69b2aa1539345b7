"""CSV with line ends inside quotes, cut into byte ranges anywhere, against Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tapeweave.sources.csv import csv_records, read_quoted_csv


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 200 bytes, so that records, quotes and line ends fall across them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("200", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_pythons(spark, tmp_path, small_ranges, end):
    rng = random.Random(3)
    want = []
    for name in ("one.csv", "two.csv"):
        rows = []
        for i in range(120):
            text = "".join(rng.choice(['a', 'b', ',', '"', "\n", "é", " "]) for _ in range(rng.randint(0, 40)))
            rows.append([str(i), text, "x" * rng.randint(1, 5)])
        out = io.StringIO(newline="")
        writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end)
        writer.writerows([["id", "body text", "c"], *rows])
        (tmp_path / name).write_bytes(out.getvalue().encode())
        want += rows
    records = csv_records(spark, str(tmp_path))
    assert records.count() == 242
    got = read_quoted_csv(spark, str(tmp_path))
    assert got.columns == ["id", "body text", "c"]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted((r[0], r[1] or "", r[2]) for r in got.collect()) == sorted(tuple(r) for r in want)


def test_corners(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('h,"two\nlines"\n\n1,"a\n\n\nb"\n2,plain\n3,"' + "long\n" * 500 + '"\n4,"open to the end')
    got = read_quoted_csv(spark, str(tmp_path / "a.csv"))
    rows = {r[0]: r[1] for r in got.collect()}
    assert got.columns == ["h", "two\nlines"] and rows["1"] == "a\n\n\nb" and rows["2"] == "plain" and rows["3"] == "long\n" * 500 and "4" in rows
    (tmp_path / "b.csv").write_text("x,y\n")
    assert read_quoted_csv(spark, str(tmp_path / "b.csv")).select(F.count("*")).first()[0] == 0
    (tmp_path / "c.csv").write_text("")
    assert read_quoted_csv(spark, str(tmp_path / "c.csv")).columns == []
