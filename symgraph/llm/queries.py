"""The queries of this subpackage and their oracle SQL, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from symgraph.llm import bpe, divergence, exact, jaccard, mixing, parsing, quality, simhash, spelling, tokens, toxicity, urls, warc
from symgraph.llm.common import spread
from symgraph.session import table

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, and back."""
    return bpe.encode_decode(spread(table(spark, sf_dir, "documents")), MULTI_RANKS, public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_groups(spread(table(spark, sf_dir, "documents"))).select("doc_id", "fingerprint", "component_id")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity audit of the pages as WARC files against a damaged replica's files."""
    return warc.audit_of_damage(spark, table(spark, sf_dir, "pages"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written as ORC and read back."""
    return tokens.round_trip(table(spark, sf_dir, "documents"), LIBRARY, public_tokenizers.PATTERN)


def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.score(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality.score(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_table(spark))


def op10_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return parsing.compare(table(spark, sf_dir, "documents"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by the overlap of their five-word shingles."""
    return jaccard.joined(spread(table(spark, sf_dir, "documents")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(spread(table(spark, sf_dir, "documents")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of each language."""
    return divergence.audit(spread(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_warc_fixity, op4_token_orc, op5_entropy_mixing, op6_exact_dedup, op7_nnpu_toxicity, op8_nbsvm_quality, op9_url_filter, op10_parsing, op11_jaccard, op12_spelling, op13_divergence)}

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
ORACLES: dict[str, str] = {"op3_warc_fixity": warc.ORACLE, "op6_exact_dedup": EXACT_SQL, "op9_url_filter": urls.ORACLE, "op11_jaccard": jaccard.ORACLE, "op12_spelling": spelling.ORACLE, "op13_divergence": divergence.ORACLE}
