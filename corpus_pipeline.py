"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Each stage is written as Parquet before the next one reads it; all but the last return the
columns of ``documents``.  Decisions: rejected documents go; of each class of near duplicates
the one with the least doc_id stays; runs of words that occur in a benchmark window are cut
out, and a document that has no other word goes; personal data is replaced by its kind;
what is left is packed.  ``n_chars`` follows the text.

Defined cases, in every stage: a null text has no words, so the quality rules reject it, and stages
that are given one by themselves keep it as it is; equal rows are judged alike; columns beside
doc_id and text keep their values, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, minhash, packing, pii, quality
from rasterloom.session import ship
from rasterloom.workspace import Workspace


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the text it has now, in the columns of ``like``."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(dict(like.dtypes)["n_chars"]))
    return docs.select(*(F.col(f"`{c}`") for c in like.columns))


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, ``row``, so that no operator's column meets one of theirs."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))


def _unpacked(found: DataFrame, like: DataFrame) -> DataFrame:
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in like.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _unpacked(quality.judge(_packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _counted(_unpacked(decontaminate.clean(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _counted(pii.redact(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Trained classifiers and tokenizer ids cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
