"""The queries of this subpackage: thin callers of its operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import compression_quality, fingerprints, html_blocks, hyperminhash, lattice_sampling, prefix_free_parsing, secret_grammar, spaced_seeds, token_counts, token_files
from vellum.session import table

#: Folder of the tokenizer files; None: the installed public_tokenizers package.
TOKENIZERS: str | None = None


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness. Null texts are empty, a null doc_id comes first in
    the order, rows that repeat a doc_id follow each other by text, a single document is its own next; see `fingerprints.compare`."""
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null and empty html give the empty text, rows that repeat are read each; see `html_blocks.extract`."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text. Null and empty texts have none, rows that repeat are scanned each; see `secret_grammar.scan`."""
    return secret_grammar.scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written to files and read back, in ascending order of doc_id, a null one first; null texts have the end
    id alone; see `token_files.round_trip`."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, decoding and sampled segmentations of every text; null and empty texts have no ids and one empty sample; see
    `lattice_sampling.encode`."""
    return lattice_sampling.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 50-byte strings of earlier documents. Null texts are empty, rows of one doc_id are
    one document, rows without one stay whole; see `prefix_free_parsing.remove_repeats`."""
    return prefix_free_parsing.remove_repeats(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's number of tokens; null and empty texts have none, rows that repeat are counted each; see `token_counts.count_tokens`."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document at four words and 80 per cent. Null texts and texts without words are linked with nothing,
    rows of one doc_id are one document, rows without one are kept; see `hyperminhash.near_duplicates`."""
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, per_cent=80)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every text; null texts hold none, null items are none, items without an id count; see `spaced_seeds.report`."""
    return spaced_seeds.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality score; null and empty texts have the score of an empty text, labels that are null or neither 0 nor 1 are
    unused, without labels of both classes all texts score alike; see `compression_quality.classify`."""
    return compression_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_html": op2_html,
    "op3_secrets": op3_secrets,
    "op4_token_files": op4_token_files,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_repeats": op6_repeats,
    "op7_token_counts": op7_token_counts,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
}
ORACLE: dict[str, str] = {}
