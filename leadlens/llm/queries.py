"""The registered queries of the training-data operators, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm import (bag_minhash, bpe_trie, divergence, line_dedup, lz_fingerprint, mixing, packing, periodic_runs,
                          pii_boost, secrets_cnn, spelling_variants, suffix_tree, url_filter)
from leadlens.llm.common import prepare
from leadlens.llm.oracle import SQL

#: (verdict, host, path) of the contract.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the contract's rules."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text; about a fifth of the texts is held out of training."""
    return suffix_tree.score(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text."""
    docs = documents(spark, sf_dir)
    return secrets_cnn.scan(docs, secrets_cnn.train(docs))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness."""
    return lz_fingerprint.with_next(documents(spark, sf_dir))


def op5_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in packed rows of 2,048; 50256 closes a document."""
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                        capacity=2048, end_id=50256)


def op6_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    return bpe_trie.encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), ids=False, digests=True)


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document against references gathered from all documents."""
    docs = documents(spark, sf_dir)
    return divergence.judge(docs, divergence.references(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return bag_minhash.classes(documents(spark, sf_dir))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line is like."""
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op11_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text."""
    docs = documents(spark, sf_dir)
    return pii_boost.digest(pii_boost.scan(docs, pii_boost.train(docs)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words and its form."""
    return spelling_variants.variants(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text, after the contract's repetitions."""
    return periodic_runs.digest(periodic_runs.find(periodic_runs.planted(documents(spark, sf_dir))))


_ALL = (op1_url_filter, op2_suffix_tree, op3_secret_scan, op4_lz_fingerprint, op5_pack_tokens, op6_bpe_trie,
        op7_quality_divergence, op8_bag_minhash, op9_fair_mix, op10_line_dedup, op11_pii_boost, op12_spelling_variants,
        op13_periodic_runs)


def _prepared(f: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)
    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _prepared(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
