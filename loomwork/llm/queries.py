"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, decontam, langid, licenses, linededup, pieces, rules, sharding, simhash, wrappers
from .common import split_bucket, table


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = crf.fit_quality(docs, labels.where(split_bucket("doc_id", 5) != 0))
    scored = crf.score_quality(docs, chain)
    return scored.select("doc_id", (split_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_kept", F.char_length("text").alias("n_chars_kept"), F.xxhash64("text").alias("text_hash"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), path=licenses.query_path()).drop("path")


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.round_trip(table(spark, sf_dir, "documents"))
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), F.octet_length("decoded").alias("n_bytes"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(split_bucket("doc_id", 3) != 1))
    found = langid.identify(docs, model)
    return found.select("doc_id", (split_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("posterior")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_crf, op2_simhash_near_dedup, op3_line_dedup, op4_license_scan, op5_html_wrappers, op6_sharding, op7_sentencepiece, op8_language_id, op9_decontamination, op10_quality_rules)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {"op4_license_scan": licenses.ORACLE_SQL, "op9_decontamination": decontam.ORACLE_SQL}
