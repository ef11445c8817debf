"""A training corpus from documents: toxicity, repeated lines, near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. run() writes each result to the
shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebase.llm import toxicity as tox
from orebase.llm.common import held_out, materialise
from orebase.llm.decontaminate import contamination
from orebase.llm.line_dedup import dedup_lines
from orebase.llm.minhash import near_duplicates
from orebase.llm.packing import packed_documents
from orebase.llm.queries import RECALL_WEIGHT

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay; a document with a null text is scored as an empty one."""
    weights = tox.train(docs, _table(spark, sf_dir, "labels"), "toxic", ~held_out(F.col("doc_id"), 5, 0), recall_weight=RECALL_WEIGHT)
    return tox.toxicity(docs.select(*COLUMNS), weights).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that at least five documents share; n_chars follows the text. No document goes."""
    changed = F.col("n_dropped") > 0
    found = dedup_lines(docs.select(*COLUMNS))
    return found.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays: five-word shingles at 0.8."""
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs, k=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a hit of a 10-word benchmark window stay."""
    # Only ids and verdicts pass through the operator's joins; texts are read where they lie.
    found = contamination(docs.select("doc_id", "text"), _table(spark, sf_dir, "benchmark")).where("contaminated")
    hit = found.select(F.xxhash64("doc_id", "text").alias("hit")).distinct()
    return docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text")).join(hit, F.col("__key") == F.col("hit"), "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash), ("decontaminate", decontaminate), ("packing", packing)]

#: A learned model, a tokenizer and a packing rule decide rows here, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
