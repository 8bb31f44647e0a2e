"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.classes(_read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    found = substring.dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, _read(spark, sf_dir, "labels"), keep_text=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    found = suffix.dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.digest(pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, _read(spark, sf_dir, "benchmark"), keep_text=False))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(_read(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokens

    return tokens.round_trip(_read(spark, sf_dir, "documents"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.decide(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import manifest

    docs = _read(spark, sf_dir, "documents")
    return manifest.verify(manifest.proofs(docs, seen=manifest.tampered(docs)))


_ALL = (
    op1_html_text, op2_minhash_dedup, op3_best_fit_packing, op4_substring_dedup, op5_quality_rules, op6_suffix_dedup, op7_pii,
    op8_decontaminate, op9_lm_scoring, op10_token_ids, op11_source_mix, op12_source_divergence, op13_merkle_manifest,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from . import divergence, manifest

    return {"op12_source_divergence": divergence.SQL, "op13_merkle_manifest": manifest.duck_sql()}
