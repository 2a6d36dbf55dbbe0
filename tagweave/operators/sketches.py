"""Approximate token counts: mergeable sketches in place of exact sets.

A document's tokens become two small sketches, one that counts distinct names
(HyperLogLog) and one that tracks frequent names (frequent items).  Sketches of
documents merge into sketches of any grouping, so a corpus is tokenized once
and rolled up by language, source or both without its tokens being shuffled.
The exact counts (:func:`tagweave.operators.match.match_stats`) stay.

The built-in sketch aggregates run in the JVM with map-side partial sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the buckets of the distinct count: a standard error of 1.04 / 2^7 = 0.8 %.
LOG_BUCKETS = 14
UNIQUE_ERROR = 1.04 / 2 ** (LOG_BUCKETS / 2)
#: Names tracked; a tracked count is off by at most ``TOP_ERROR`` of all tokens.
TRACKED = 1024
TOP_ERROR = 3.5 / TRACKED


def token_sketches(tokens: DataFrame, *by: str) -> DataFrame:
    """``(by, n_tokens, names, top)`` from ``(by, toks)`` rows of token arrays: one row per
    value of ``by``; documents without tokens have none."""
    return tokens.select(*by, F.explode("toks").alias("name")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.hll_sketch_agg("name", LOG_BUCKETS).alias("names"),
        F.expr(f"approx_top_k_accumulate(name, {TRACKED})").alias("top"),
    )


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of a coarser grouping."""
    return sketches.groupBy(*by).agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.hll_union_agg("names").alias("names"),
        F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"),
    )


def read_sketches(sketches: DataFrame, *by: str, k: int = 10) -> DataFrame:
    """``(by, n_tokens, unique_tokens, top)``: estimates; ``top`` is an array of the ``k``
    most frequent ``(item, count)``."""
    return sketches.select(
        *by,
        "n_tokens",
        F.hll_sketch_estimate("names").alias("unique_tokens"),
        F.expr(f"approx_top_k_estimate(top, {k})").alias("top"),
    )
