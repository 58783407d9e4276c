"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import benchmark_leaks, best_positions, class_lm, delta_rollup, kd_shards, pareto_mix, phrase_mining, region_join
from framelake.llm import secret_scan, simple8b_store, topk_blocks, toxicity, vector_copies

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (pareto_mix, simple8b_store, kd_shards, region_join, class_lm, toxicity, secret_scan, topk_blocks, benchmark_leaks, delta_rollup,
           phrase_mining, vector_copies, best_positions)


def queries() -> dict[str, Query]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
