"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.llm import bpe, exact_dedup, mixing, simhash, toxicity
from siteaudit.llm.common import cut
from siteaudit.llm.queries import MIX_DOMAIN, MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, rank_file, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model grades above 0 go. It is fitted on labelled documents of docs."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, 0.8 or more) the one with the smallest doc_id stays."""
    return simhash.drop_similar(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one that is taken in two epochs is there twice."""
    return mixing.mix_documents(docs, F.expr(MIX_DOMAIN), {k: F.expr(v) for k, v in MIX_WEIGHTS.items()}, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    coded = bpe.round_trip(docs, *rank_file())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixed), ("bpe", encoded)]

#: SQL has neither the fitted model, nor SimHash, nor BPE: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
