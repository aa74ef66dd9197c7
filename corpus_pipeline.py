"""From raw documents to token ids: five stages, each calling one training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontam, langid, linededup, pieces, similar
from loomwork.llm.common import split_bucket, stash, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or with a score below 0.5, go."""
    model = langid.fit_languages(docs.where(split_bucket("doc_id", 3) != 1))
    return langid.keep_identified(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stood before in the corpus (within an edit, from 20 characters on); n_chars follows the text."""
    return linededup.replace_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more: the one with the smallest id.

    SimHash links within four bits come first; prefix filtering adds those that lie further apart.
    """
    return similar.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, segmented with seeded merge-dropout, and whether they decode to the text."""
    both = pieces.round_trip(docs)
    return both.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs


#: The stages learn models, hash with XXH64 and walk graphs, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None
