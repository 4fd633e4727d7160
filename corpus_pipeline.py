"""The training-data pipeline over ``documents``: every stage works on all rows its predecessor kept.

Documents that the quality rules reject go, with all documents of rejected hosts; of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one
document stays; passages of 200 bytes or more that still repeat are cut out; sources are mixed to their target weights, which repeats or cuts documents; and
what is left is encoded to piece ids and decoded again. Clashing columns can't be told apart by name, so ``documents`` must have each name once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehist.llm import minhash, mixing, piece_bpe, quality_rules, suffix_dedup
from codehist.llm.tables import new_folder, table
from codehist.session import remove, tables_made

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MODEL = public_tokenizers.path("piece_bpe_32k.model")


_left: dict[str, list[str]] = {}


def owning_tables(stage: Stage) -> Stage:
    """A stage removes the tables that the one before it has staged: its result is written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        remove(spark, _left.pop(app, []))
        with tables_made() as paths:
            out = stage(spark, docs, sf_dir)
        _left[app] = paths
        return out

    return run_stage


@owning_tables
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


@owning_tables
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


@owning_tables
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@owning_tables
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@owning_tables
def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, and what decoding them gives: text, n_tokens, ids_crc32."""
    keep = ["doc_id", "lang", "source"]
    return piece_bpe.decode(piece_bpe.encode(docs, MODEL, keep), MODEL, [*keep, "ids"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("minhash", keep_one_of_each),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("piece_bpe", to_pieces),
]

#: SQL cannot express the piece ids; tests/llm/test_pipeline.py works every stage out by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
