"""Queries over the operators of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repoloom.llm import bpe, mixing, pairs, pii, provenance, secrets, splitting, syntax
from repoloom.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.found(table(spark, sf_dir, "files"))


def p6_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.errors(table(spark, sf_dir, "files"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(table(spark, sf_dir, "files"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_stats(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the shares reached are those wanted."""
    return mixing.checked(p8_shares(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.found(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_configs"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_configs"))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold of the pieces of each oversized chunk."""
    whole = splitting.coverage(p2_pieces(spark, sf_dir))
    return whole.select("chunk_id", "n_chars", "first_start", "last_end", "wrong_texts")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.found(table(spark, sf_dir, "question_runs"), table(spark, sf_dir, "golden_items"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.found(table(spark, sf_dir, "files"))


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.labels(table(spark, sf_dir, "files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(table(spark, sf_dir, "chunks"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted(table(spark, sf_dir, "chunks"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_coverage": p2_coverage, "p3_found": p3_found, "p4_found": p4_found, "p4_labels": p4_labels, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_errors": p6_errors, "p6_rates": p6_rates, "p7_ids": p7_ids, "p7_token_stats": p7_token_stats, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_check": p8_check, "p9_found": p9_found, "p9_masked": p9_masked}
ORACLES: dict[str, str] = {
    "p2_found": """
        SELECT DISTINCT c.chunk_id FROM chunks c
        JOIN chunk_configs g ON g.config_id = coalesce(c.config_id, 1)
        WHERE length(c.text) > g.max_chars""",
    "p2_coverage": """
        SELECT DISTINCT c.chunk_id, length(c.text) AS n_chars, 0 AS first_start, length(c.text) AS last_end, 0 AS wrong_texts FROM chunks c
        JOIN chunk_configs g ON g.config_id = coalesce(c.config_id, 1)
        WHERE length(c.text) > g.max_chars""",
    "p8_check": """
        SELECT mix_id, source, target_share > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0) AS gave, true AS near_target, true AS within_repeats FROM mix_targets t""",
}
