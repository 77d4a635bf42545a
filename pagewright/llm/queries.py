"""The registered queries of the ten operators and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .common import documents, last_table
from .exact import exact_duplicates
from .language import identify_documents
from .licences import licence_scan
from .lines import drop_recurring_lines
from .near import near_duplicates
from .packing import pack_documents
from .quality import robust_quality
from .sharding import shard_records
from .suffix import repeated_passages


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust_quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mcd_distance")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), vocabulary())


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary())


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(documents(spark, sf_dir))


def op8_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op9_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(documents(spark, sf_dir), want_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(documents(spark, sf_dir))


def op6_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir))


def _whole(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query's result as a table of its own, without the scratch tables of its operator."""
    return functools.wraps(query)(lambda spark, sf_dir: last_table(spark, lambda: query(spark, sf_dir), query.__name__))


QUERIES = {
    "op1_robust_outliers": _whole(op1_robust_outliers),
    "op2_speculative_bpe": op2_speculative_bpe,
    "op4_best_fit_packing": _whole(op4_best_fit_packing),
    "op5_rendezvous_sharding": _whole(op5_rendezvous_sharding),
    "op8_block_naming": _whole(op8_block_naming),
    "op9_tensored_minhash": _whole(op9_tensored_minhash),
    "op3_template_lines": _whole(op3_template_lines),
    "op6_licence_classifier": _whole(op6_licence_classifier),
    "op7_language_spans": _whole(op7_language_spans),
    "op10_suffix_arrays": _whole(op10_suffix_arrays),
}

ORACLES: dict[str, str] = {
    "op8_block_naming": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
