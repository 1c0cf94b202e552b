"""Corpus preparation: quality, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared
folder and rereads it as the next stage's docs.  All stages but the last return the columns of documents.
Nulls, empty and very long texts, repeated rows, empty tables and further columns are handled as the
operators define; rows without a doc_id are kept by every filter but quality, which judges their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import PATTERN, path

from barloom.llm import _session, bpe, decontaminate, near_dedup, pseudonyms, quality

KEY = "fixed key of the pipeline"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts (score >= 0.3)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, metadata=["n_chars"])
    return quality.accepted(docs, model, metadata=["n_chars"], threshold=0.3)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group (five words, 0.8).

    Of several rows with that doc_id the one with the smallest hash of its text stays.
    """
    groups = near_dedup.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    gone = groups.where("not kept").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = rest.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    once = rest.join(twice, "doc_id", "left_anti").select(docs.columns)
    row = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))).alias("row")
    return once.union(rest.join(twice, "doc_id").select(docs.columns).groupBy("doc_id").agg(row).select("row.*").select(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms; n_chars follows the text."""
    out = pseudonyms.pseudonymise(docs, KEY, counts=False)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text and the text that they decode to; null texts are empty, every row stays."""
    ranks = path("byte_bpe_50k.tiktoken")
    out = bpe.encode(docs, ranks, PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", "token_ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote on the way and the stage before it go once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = len(_session._MADE)
    for name, stage in STAGES:
        docs = _session.table(stage(spark, docs, sf_dir), f"stage-{name}")
        _session.release(spark, first)
    return docs


#: The classifier and the keyed permutations have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None
