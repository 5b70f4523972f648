"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and
returns a DataFrame that is written as Parquet and read again for the next one. All but
the last return the columns of ``documents``. Documents without an id are judged like
others; near-duplicate detection keeps them. The stages' operators define nulls, empty texts
and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.llm.hyperminhash import BROADCAST_IDS, near_duplicates
from changegraph.llm.mixing import mixed_documents
from changegraph.llm.packing import pack_documents
from changegraph.llm.queries import tokenizer_file
from changegraph.llm.substring_dedup import remove_repeats
from changegraph.llm.text import materialise
from changegraph.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Documents whose key is not in ``ids``; the list travels to all tasks only while it is short."""
    ids = materialise(ids.distinct(), "rejected")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose nearest labelled examples make them toxic (score of 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    key = F.coalesce(F.col("doc_id").cast("long"), -1 - F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1)))
    docs = docs.select(*COLUMNS).withColumn("_key", key)
    rejected = score_toxicity(docs, labels, id_col="_key").where("score >= 0.5").select("_key")
    return _without(docs, rejected, "_key").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (five-word shingles, similarity 0.8)."""
    docs = docs.select(*COLUMNS)
    rejected = near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id")
    return _without(docs, rejected, "doc_id").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that an earlier document has; texts without any stay as they are."""
    out = remove_repeats(docs, window=50, period=13, carry=("lang", "source"), keep_untouched=True)
    out = out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return out.select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the mix's documents, a row a copy; the last one of a source may be cut."""
    out = mixed_documents(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of at most 1024 tokens."""
    return pack_documents(docs, tokenizer_file(), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]
#: Learned scores, sketches and seeded draws are not SQL; tests/llm/test_pipeline.py holds the stages against planted
#: cases, brute force, targets and invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
