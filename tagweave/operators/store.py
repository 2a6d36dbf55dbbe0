"""Read-or-build index store.

Every build has a number.  Its rows lie under ``rows/build=<n>/bucket=<b>``,
where the bucket is a hash of ``cache_key`` (a fixed number of folders however
many units there are), and ``keys/build=<n>`` lists the units that it built,
also those that got no rows.  The latest build that lists a unit holds all of
its rows, so a rebuild to nothing leaves nothing behind, and a build that
fails half-way is not seen: its keys are written last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import cut_lineage, read_if_exists

BUCKETS = 64


def _bucket(key: str = "cache_key"):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def latest_builds(keys: DataFrame) -> DataFrame:
    """``(cache_key, build)``: the last build of each unit."""
    return keys.groupBy("cache_key").agg(F.max("build").alias("build"))


def stored_rows(spark, store_path: str, wanted: DataFrame) -> DataFrame | None:
    """Index rows of ``wanted (cache_key)``; only the folders of the builds and
    buckets that hold them are read.  ``None`` if the store has no rows at all."""
    keys = read_if_exists(spark, f"{store_path}/keys")
    rows = read_if_exists(spark, f"{store_path}/rows")
    if keys is None or rows is None:
        return None
    current = cut_lineage(latest_builds(keys).join(wanted.select("cache_key").distinct(), "cache_key", "left_semi"))
    buckets = [r[0] for r in current.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS
    return (
        rows.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        .join(current, ["cache_key", "build"], "left_semi")
        .drop("build", "bucket")
    )


def index_or_build(
    units: DataFrame,
    store_path: str,
    build: Callable[[DataFrame], DataFrame],
    seen: DataFrame | None = None,
) -> DataFrame:
    """Index rows ``(cache_key, ...)`` for every unit in ``units`` (``cache_key``
    column required).

    ``build(units_to_build)`` returns index rows with a ``cache_key`` column.
    ``seen``: ``(cache_key)`` of units that were closed before and are always
    rebuilt.  The stored/build decision is checkpointed before the store is
    written, so it cannot shift when the store's file listing changes.
    """
    spark = units.sparkSession
    wanted = units.select("cache_key").distinct()
    stored = read_if_exists(spark, f"{store_path}/keys")
    to_build, number = wanted, 0
    if stored is not None:
        number = (stored.agg(F.max("build")).first()[0] or 0) + 1
        known = stored.select("cache_key").distinct()
        if seen is not None:
            known = known.join(seen.select("cache_key").distinct(), "cache_key", "left_anti")
        to_build = wanted.join(known, "cache_key", "left_anti")
    to_build = cut_lineage(to_build)
    if stored is None or not to_build.isEmpty():
        built = build(units.join(to_build, "cache_key", "left_semi"))
        (
            built.withColumn("bucket", _bucket())
            .repartition("bucket", "cache_key")
            .sortWithinPartitions("bucket", "cache_key")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{store_path}/rows/build={number}")
        )
        to_build.write.mode("overwrite").parquet(f"{store_path}/keys/build={number}")
        spark.catalog.refreshByPath(store_path)
    return stored_rows(spark, store_path, wanted)
