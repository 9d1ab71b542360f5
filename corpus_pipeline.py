"""From documents to token ids: language ID, line dedup, near-dedup, decontamination, SentencePiece.

Each stage reads all that its predecessor kept and, but for the last, returns the columns of ``documents``.

Defined results of every stage: null keys, languages, sources and sizes are carried along as they are; extra columns aren't
read, whatever their names; repeated rows are rows of their own; an empty table gives an empty one; very long texts are
treated whole. Language ID drops null texts and those without a letter, of equal probabilities it takes the label first in
order; line dedup keeps null and empty texts and of equal passages the first by key, row and place; near-dedup keeps every
text without a word, and of a group the row with the smallest key, then the first; decontamination keeps texts without a
word; encoding gives null and empty texts no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _store, decontaminate, language_id, line_dedup, near_dups, pieces

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    """``documents``' columns from a key, a text and the columns carried along."""
    return df.select(F.col("key").alias("doc_id"), "text", "kept.lang", "kept.source", F.length("text").cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language has at least half the probability."""
    net = language_id.train_language_id(docs)
    found = language_id.identify_languages(docs, net, keep=COLUMNS)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= 0.5)).select("kept.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go; so does a document of which that leaves no word."""
    found = line_dedup.dedup_lines(docs, keep=("lang", "source"), passages=True)
    emptied = (F.col("n_removed_chunks") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return _columns(found.where(~emptied))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words a shingle, similarity 0.8 or more."""
    found = near_dups.near_duplicates(docs, keep=("lang", "source"), keep_texts=True)
    return _columns(_store.with_texts(found.where("first")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.benchmark_matches(docs, benchmark, keep=COLUMNS)
    return found.where(~decontaminate.is_contaminated()).select("kept.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    found = pieces.encode_pieces(docs, keep=("lang", "source"))
    return found.select("doc_id", "kept.lang", "kept.source", "n_pieces", "ids_crc32", "round_trip", "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]
#: SQL can't express the language model, nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = _store.work_dir(spark)
    for name, stage in STAGES:
        docs = _store.written(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
