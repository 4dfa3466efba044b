"""The text operators as a pipeline over the documents table: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _tokens, contamination, jaccard, language, packing, suffixes

#: A text with letters goes only if its best language is less sure than this.
LEAST_SURE = 0.4


def _named(docs: DataFrame) -> DataFrame:
    """Texts under a doc_id that tells several texts of one id apart: (__id, __mark)."""
    return docs.select("text", F.struct(F.col("doc_id").alias("__id"), suffixes.mark(F.col("text")).alias("__mark")).alias("doc_id"))


def _same(docs: DataFrame):
    return docs["doc_id"].eqNullSafe(F.col("__id")) & (suffixes.mark(docs["text"]) == F.col("__mark"))


@_shared.stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, null ones included, and texts whose best language is unsure.

    Rows are judged by their text alone: rows that repeat a text share its fate, and rows without doc_id are judged too.
    """
    told = language.predict(_named(docs), language.learned(docs))
    sure = told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select("doc_id.*").distinct()
    return docs.join(sure, _same(docs), "left_semi").select(docs.columns)


@_shared.stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked rows: that with the smallest doc_id. Texts without words, or null, all stay.

    Two texts under one doc_id, and rows without doc_id, are rows of their own; of rows that repeat both one stays.
    """
    return jaccard.leaders(docs)


@_shared.stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a text of which nothing is left goes, so do null and empty ones.

    What is cut within a character is mended. Rows that repeat a doc_id and text repeat each other's passages.
    """
    left = suffixes.cut(docs, *[c for c in docs.columns if c not in ("text", "n_chars")]).where("octet_length(kept) > 0")
    text = F.expr("make_valid_utf8(cast(kept AS string))")
    return left.select("row.*", text.alias("text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_shared.stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item; null and empty texts hold none and stay.

    Rows are judged by their text alone, so rows without doc_id are judged and another text under the same doc_id stays.
    """
    found = contamination.contaminated(_named(docs), _shared.read(spark, sf_dir, "benchmark")).select("doc_id.*").distinct()
    return docs.join(found, _same(docs), "left_anti").select(docs.columns)


@_shared.stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null or empty text is a document of the end id alone, repeated rows come as often."""
    return packing.pack(docs, _tokens.default_path())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]
#: Models and sequences cannot be written in SQL; tests hold each stage against its operator's brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each is written to the shared folder and reread as the next one's documents.

    A stage begins by dropping the tables that the stages before it wrote for themselves.
    """
    docs = _shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
