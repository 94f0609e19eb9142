"""The corpus pipeline: quality classifier, near-dedup, benchmark decontamination, secret scan, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. run() writes each stage's result
to the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import compression_quality, hyperminhash, lattice_sampling, secret_grammar, spaced_seeds
from vellum.llm.common import give_back_heap, stored
from vellum.llm.queries import tokenizer
from vellum.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    return compression_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return hyperminhash.keep_one(docs, size=5, per_cent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return spaced_seeds.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of their secrets."""
    return secret_grammar.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and sampled segmentations of each document. Its Python workers are the pipeline's largest and come behind
    stages that fill the JVM's heap."""
    give_back_heap(spark)
    return lattice_sampling.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_secrets", redact_secrets), ("encode", encode)]

#: Trained models, tokenizers and sampling aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
