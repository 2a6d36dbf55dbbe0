"""Order-dependent operators that stay parallel under key skew.

``lag`` over ``PARTITION BY key ORDER BY ts`` sends a whole key to one task;
a key may hold a third of the data (``event_type`` has five values).  Here a
key with more than a task's share of the rows is cut into ranges of its order
by splitters from a sample, as a range partitioner would choose them, and the
window partition is (key, range).  The only information that crosses a border
-- the last row of the range before -- comes from a summary of one row per
range of a hot key.  Keys below a task's share stay whole and need neither.

Splitters are places in the whole order (ties of the leading column included),
so any set of them gives the same result; they only decide the balance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Sampled rows per task; ranges of a hot key then differ by some ten per cent.
SAMPLES = 100
#: The binary search has this many steps: enough for a million splitters of a key.
_STEPS = 20
_GRAINS = 1 << 40


def default_tasks(df: DataFrame) -> int:
    """Eight times the session's shuffle partitions: ranges are dealt to tasks by hash, and
    with eight to a task no task gets much more than its share."""
    return 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_splitters(df: DataFrame, keys: list[str], order: list[str], tasks: int) -> DataFrame:
    """``(keys, splits)`` of the keys with more than ``1 / tasks`` of the rows: at most
    ``tasks`` rows with about ``2 * tasks`` sorted splitters in all.

    Rows are sampled by a hash of key and order, ``SAMPLES`` per task on average
    however many rows there are; rows that are equal in both are one place.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(1)))
    hot = counts.withColumn("_total", total.scalar()).where(F.col("_n") * tasks > F.col("_total")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.ceil(F.col("_n") * tasks / F.col("_total")).cast("int").alias("_ranges"),
        (F.lit(float(_GRAINS)) * SAMPLES * tasks / F.col("_total")).alias("_below"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    place = F.struct(*[F.col(c) for c in order])
    grain = F.pmod(F.xxhash64(*keys, *order), F.lit(_GRAINS))
    sampled = (
        df.select(*keys, place.alias("_place"), grain.alias("_grain"))
        .join(F.broadcast(hot), same)
        .where(F.col("_grain") < F.col("_below"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("_place")).alias("_s"), F.max("_ranges").alias("_ranges"))
    )
    cut = F.expr("transform(sequence(1, greatest(_ranges - 1, 1)), i -> _s[cast(i * size(_s) div greatest(_ranges, 2) as int)])")
    return sampled.select(*keys, F.array_distinct(cut).alias("splits"))


def _range_of(splits: Column, place: Column) -> Column:
    """How many of the sorted ``splits`` are at or before ``place`` (binary search)."""

    def step(found: Column, width: Column) -> Column:
        ahead = found + width
        fits = (ahead <= F.size(splits)) & (F.get(splits, ahead - 1) <= place)
        return F.when(fits, ahead).otherwise(found)

    widths = F.array(*[F.lit(1 << b) for b in reversed(range(_STEPS))])
    return F.when(splits.isNull(), F.lit(0)).otherwise(F.aggregate(widths, F.lit(0), step))


def ordered_lag(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    prefix: str = "prev_",
    tasks: int | None = None,
) -> DataFrame:
    """Add ``prev_<v>`` (previous row's value in ``order`` within ``keys``)
    and ``has_prev`` to ``df``.

    One exchange of the rows, by (key, range); both joined tables have at most some
    ``2 * tasks`` rows, which bounds the broadcasts.  Null keys are one key, and null
    places come first.  Rows equal in key and order follow each other in any order.
    """
    tasks = tasks or default_tasks(df)
    names = [f"_k{i}" for i in range(len(keys))]
    renamed = [F.col(k).alias(n) for k, n in zip(keys, names)]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    place = F.struct(*[F.col(c) for c in order])
    packed = F.struct(*[F.col(v).alias(v) for v in values])

    splits = hot_splitters(df, keys, order, tasks).select(*renamed, "splits")
    x = df.join(F.broadcast(splits), same, "left").withColumn("_range", _range_of(F.col("splits"), place))
    x = x.withColumn("_hot", F.col("splits").isNotNull()).drop("splits", *names)

    # The last row of every range of a hot key, added up before it is sent, and for
    # every range the last row of the one before it.
    last = x.where("_hot").groupBy(*keys, "_range").agg(F.max_by(packed, place).alias("_last"))
    by_key = Window.partitionBy(*keys).orderBy("_range")
    carry = last.select(*renamed, F.col("_range").alias("_r"), F.lag("_last").over(by_key).alias("_before"))

    in_range = Window.partitionBy(*keys, "_range").orderBy(*order)
    y = x.withColumn("_prev_in", F.lag(packed).over(in_range))
    y = y.join(F.broadcast(carry), same & (F.col("_range") == F.col("_r")), "left")
    prev = F.coalesce("_prev_in", "_before")  # a struct of nulls is not null
    y = y.withColumn("_prev", prev)
    out = [F.col(c) for c in df.columns]
    out += [F.col("_prev")[v].alias(prefix + v) for v in values]
    out.append(F.col("_prev").isNotNull().alias("has_prev"))
    return y.select(*out)


def first_occurrence_order(
    df: DataFrame, key: str, item: str, order: list[str], pos: str = "pos"
) -> DataFrame:
    """Order-preserving distinct: ``(key, item, pos)`` where ``pos`` (1-based)
    ranks items by their first occurrence; empty/null items are dropped.

    The (key, item) aggregate runs partially map-side, so a hot key is reduced
    to one row per distinct item before the per-key ranking.
    """
    first = (
        df.where(F.col(item).isNotNull() & (F.col(item) != ""))
        .groupBy(key, item)
        .agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first"))
    )
    w = Window.partitionBy(key).orderBy("_first")
    return first.select(key, item, F.row_number().over(w).cast("bigint").alias(pos))
