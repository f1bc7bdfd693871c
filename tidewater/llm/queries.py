"""The dealt operators' queries with production parameters; each is applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, centroids, mtree, packing, phrases, pii, quality_rules, simhash, tokens, url_filter, warc, weak_labels
from .common import read


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), vocabulary())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_decode(read(spark, sf_dir, "documents"), vocabulary())


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in sequences of at most 4096 ids, 4 conversations and 3200 ids that bear loss."""
    examples = packing.conversation_examples(read(spark, sf_dir, "conversations"), vocabulary())
    return packing.pack_examples(examples, 4096, 4, 3200).join(examples, "example_id")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_warc, op3_weak_labels, op4_packing, op5_pii, op6_mtree, op7_simhash, op8_quality_rules, op9_token_counts, op10_bpe, op11_centroids, op12_byte_bpe, op13_phrases, instruction_packing)}
ORACLE_SQL: dict[str, str] = {"op2_warc": warc.ORACLE_SQL, "op6_mtree": mtree.ORACLE_SQL, "op8_quality_rules": quality_rules.ORACLE_SQL, "op11_centroids": centroids.ORACLE_SQL, "op13_phrases": phrases.ORACLE_SQL}
