"""Corpus pipeline: documents in, token ids out, each stage one operator of the ``llm`` subpackage.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as the docs
of the next one. All but the last return the columns of documents.

Rows are judged one by one, by a number of their own: rows that share a doc_id, or have none, stay or go by their own text.

Cases: null and empty texts, and texts without words, are no copies of each other and stay; of rows that repeat or are near copies one
stays, the one of smallest doc_id (a null one last), and of equal doc_ids the first read; stages keep further columns, whatever
their names; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molkeys.llm import jaccard_join, lattice, secret_forest, toxic_crf, winnow
from molkeys.llm.common import for_long_texts, materialise
from molkeys.llm.queries import table, tokenizer_file


def record(docs: DataFrame) -> Column:
    """A row as one column, so that no name of its columns can clash with those that a stage adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")


def numbered(docs: DataFrame) -> DataFrame:
    """(row, own, doc_id, text): rows with a number of their own, written so that it holds."""
    for_long_texts(docs.sparkSession)
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), record(docs), "doc_id", "text"), "numbered", compression="zstd")


def without(rows: DataFrame, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """The numbered rows that are not in ``gone``, with the columns of docs."""
    gone = materialise(gone, "gone")
    kept = rows.join(winnow.bounded(gone, gone.count()), "row", "left_anti")
    return kept.select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under one half; the field is trained on the documents that have labels."""
    model = toxic_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = toxic_crf.score(docs.select(record(docs), "text"), model, "own")
    return scored.where("score < 0.5").select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of smallest doc_id: sets of five words with a similarity of 0.8."""
    rows = numbered(docs)
    groups = jaccard_join.jaccard_groups(rows.select(F.col("row").alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    groups = materialise(groups, "groups")
    # rows alone in their group stay; of the others, few as they are, the first by doc_id, null last
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    named = rows.select("row", "doc_id").join(groups.join(several, "component_id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select("component_id", F.col("x.row").alias("stays"))
    return without(rows, named.join(first, "component_id").where("row <> stays").select("row"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    rows = numbered(docs)
    hits = winnow.find_hits(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, hits.select(F.col("doc_id").alias("row")).distinct(), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text."""
    out = secret_forest.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: numbers of units and tokens, the hash of its ids, whether they decode to the text, and the ids in order."""
    for_long_texts(spark)
    return lattice.encode_summary(docs, lattice.load_model(tokenizer_file("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: The toxicity model, the forest and the merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
