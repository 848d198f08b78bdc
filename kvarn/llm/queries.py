"""The queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvarn.session import ship

from . import decontaminate, license_scan, ngram_join, oracles, packing, quality_bt, quality_rules, sharding, suffix_tree, surrogates, warc
from .common import columns

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"))


def op9_quality_bt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op5_packing, op7_sharding, op9_quality_bt, op10_warc)}
SQL: dict[str, str] = oracles.SQL


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(_table(spark, sf_dir, "documents"))


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


QUERIES |= {f.__name__: f for f in (op2_ngram_join, op8_lm_scores)}


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


QUERIES |= {"op1_decontaminate": op1_decontaminate}


def op3_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(_table(spark, sf_dir, "documents"), "doc_id", "text")
    out = quality_rules.judge(docs, _table(spark, sf_dir, "labels"))
    return out.select("_row.doc_id", *[c for c in out.columns if c != "_row"])


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replaced(columns(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("_row.doc_id", F.col("_text").alias("text"), F.size("_entities").cast("long").alias("n_entities"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.judge(docs, _table(spark, sf_dir, "labels")).filter("kept").select("_row.*")


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = surrogates.replaced(docs)
    own = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return changed.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


QUERIES |= {f.__name__: f for f in (op3_quality_llr, op4_license_scan, op6_pii_surrogates)}
