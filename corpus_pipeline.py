"""A corpus pipeline: language, toxicity, near duplicates, mix of sources, pieces.

Every stage works on all documents its predecessor kept; all but the last return the columns of documents. A
stage defines its result for null ids and texts, repeated rows and empty tables in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.langid import UNKNOWN, fit_languages, identify_languages
from tapeweave.llm.minhash import duplicate_classes
from tapeweave.llm.mixing import mix_sources
from tapeweave.llm.pieces import encode_pieces
from tapeweave.llm.queries import remainder, tokenizer_file
from tapeweave.llm.toxicity import fit_toxicity, score_toxicity
from tapeweave.session import materialize

#: Score from which a document counts as toxic.
TOXIC = 0.7


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, learned from two thirds of those that have one.

    Null texts and texts without letters go; other columns may be null, and repeated rows stay or go together. An
    empty table stays empty; where no row has a language, nothing is recognised and all go.
    """
    model = fit_languages(docs, remainder("doc_id", 3) != 1)
    kept = identify_languages(docs, model, out="_lang", score="_cosine").filter(F.col("_lang") != UNKNOWN)
    return kept.select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``, learned from two thirds of the labelled ones among them.

    Null and empty texts have no word to judge and stay, whatever the model's score of no words is; repeated rows
    stay or go together; an empty table stays empty; without labels of both classes all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, remainder("doc_id", 3) != 1)
    stays = (F.col("_toxic") < TOXIC) | F.col("text").isNull() | (F.col("text") == "")
    return score_toxicity(docs, model, out="_toxic").filter(stays).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates: the one with the least id, null last.

    Null texts are no one's copy and stay. Of repeated rows, and of rows that share id and text, one stays. An
    empty table stays empty.
    """
    found = materialize(duplicate_classes(docs).filter("key IS NOT NULL"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key"))
    first = found.groupBy("class_node").agg(F.min(rank).alias("first"))
    # Only classes of several rows have something to drop; the rest never meets a join.
    several = found.groupBy("class_node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class_node")
    ranked = found.join(several, "class_node").join(first, "class_node").withColumn("_kept", rank == F.col("first"))
    gone = ranked.filter("NOT _kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    again = materialize(
        ranked.filter("_kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.unhex(F.md5("text")) == F.col("_key"))
    kept = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept
    repeated = docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(repeated)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: every document as often as the mix takes it, up to three times.

    Null and empty texts have no words and are never taken; a null source is a source; each of several equal rows is
    a document of its own; an empty table stays empty.
    """
    # Stored with a number per row, so that repeated and null ids keep their rows apart.
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    taken = mix_sources(rows, row="_row").filter("copies > 0").select("_row", "copies")
    return rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of every document, and the three best ones' scores.

    A null text has no ids; repeated rows stay; an empty table gives no row.
    """
    return encode_pieces(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model")).withColumn(
        "n_tokens", F.size("ids").cast("bigint")
    )


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each),
    ("source_mix", mixed),
    ("pieces", in_pieces),
]

# Learned models and hashes of shingles have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
