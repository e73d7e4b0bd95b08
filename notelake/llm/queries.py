"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from notelake.session import table


def _over(module: str, function: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"notelake.llm.{module}"), function)(table(spark, sf_dir, name))


def _labelled(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"notelake.llm.{module}"), function)(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _tables(module: str, function: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"notelake.llm.{module}"), function)(*(table(spark, sf_dir, n) for n in names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_ledger": _over("secret_ledger", "secrets", "documents"),
        "op2_bitsliced_topk": _over("bitsliced_topk", "nearest", "embeddings"),
        "op3_warc_store": _over("warc_store", "archived", "pages"),
        "op4_simhash_dedup": _over("simhash_dedup", "simhash_groups", "documents"),
        "op5_toxicity": _labelled("toxicity", "toxicity"),
        "op6_poisson_mix": _over("poisson_mix", "mixture", "documents"),
        "op7_suffix_repeat": _over("suffix_repeat", "judge", "documents"),
        "op8_line_dedup": _over("line_dedup", "dedup_digests", "documents"),
        "op9_crf_quality": _labelled("crf_quality", "quality"),
        "op10_packing": _over("packing", "pack_documents", "documents"),
        "op11_tolerant_asof": _tables("tolerant_asof", "click_orders", "clicks", "sales"),
        "op12_token_alignment": _over("token_alignment", "align", "documents"),
        "op13_minimax_shards": _over("minimax_shards", "sharded", "documents"),
    }


def oracle_sql() -> dict[str, str]:
    from notelake.llm import bitsliced_topk, line_dedup, minimax_shards, poisson_mix, secret_ledger, tolerant_asof, warc_store

    return {
        "op1_secret_ledger": secret_ledger.ORACLE_SQL,
        "op2_bitsliced_topk": bitsliced_topk.ORACLE_SQL,
        "op3_warc_store": warc_store.ORACLE_SQL,
        "op6_poisson_mix": poisson_mix.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op11_tolerant_asof": tolerant_asof.ORACLE_SQL,
        "op13_minimax_shards": minimax_shards.ORACLE_SQL,
    }
