import os

import pytest

from pyspark.sql import functions as F

from tagweave.functions.text import join_lines
from tagweave.operators.projects import find_buffers
from tagweave.operators.store import index_or_build, stored_rows


def test_index_or_build(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    calls = []

    def build(units):
        calls.append(sorted(r.cache_key for r in units.select("cache_key").collect()))
        return units.select("cache_key", F.concat(F.lit("tag_"), "cache_key").alias("line"))

    units = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    first = sorted((r.cache_key, r.line) for r in index_or_build(units, store, build).collect())
    assert first == [("a", "tag_a"), ("b", "tag_b")] and calls == [["a", "b"]]
    more = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    seen = spark.createDataFrame([("b",)], "cache_key string")
    second = sorted((r.cache_key, r.line) for r in index_or_build(more, store, build, seen).collect())
    assert calls[1] == ["b", "c"]
    assert second == [("a", "tag_a"), ("b", "tag_b"), ("c", "tag_c")]


def test_join_lines_and_find_buffers(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "l array<string>")
    assert [r.t for r in df.select(join_lines("l").alias("t")).collect()] == ["a\nb\n", ""]
    bufs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, f string")
    ids = spark.createDataFrame([(2,), (9,)], "doc_id long")
    assert [r.f for r in find_buffers(bufs, ids).collect()] == ["y"]


def test_rebuild_to_nothing_leaves_nothing(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    units = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    build = lambda u: u.select("cache_key", F.lit("old").alias("line"))
    assert index_or_build(units, store, build).count() == 2
    nothing = lambda u: u.select("cache_key", F.lit("x").alias("line")).limit(0)
    seen = spark.createDataFrame([("b",)], "cache_key string")
    got = index_or_build(units, store, nothing, seen)
    assert [tuple(r) for r in got.collect()] == [("a", "old")]
    assert [tuple(r) for r in index_or_build(units, store, nothing).collect()] == [("a", "old")]


def test_store_read_is_pruned(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    units = spark.createDataFrame([(f"k{i}",) for i in range(200)], "cache_key string")
    build = lambda u: u.select("cache_key", F.lit("row").alias("line"))
    index_or_build(units, store, build)
    one = stored_rows(spark, store, spark.createDataFrame([("k7",)], "cache_key string"))
    assert [tuple(r) for r in one.collect()] == [("k7", "row")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_broken_store_is_not_rebuilt(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad", "keys")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.parquet"), "wb") as f:
        f.write(b"not parquet")
    units = spark.createDataFrame([("a",)], "cache_key string")
    with pytest.raises(Exception):
        index_or_build(units, os.path.join(tmp_dir, "bad"), lambda u: u.select("cache_key")).collect()
