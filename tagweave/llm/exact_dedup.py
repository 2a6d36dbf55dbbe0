"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of ``block_bytes`` bytes.  All distinct
blocks of the corpus are sorted and named by integers; then adjacent names
are paired, the distinct pairs sorted and named again, until one name per
document is left.  Equal (byte length, name) means equal text and nothing
else does: a name stands for one block content, or for one pair of names.

Blocks are routed by a 128-bit key, and the same pass that names them holds
that no key stands for two contents; if one did, all is named anew under
another seed.  So texts are shuffled once, distinct blocks only, and names
are joined back by the key.

Defined cases: a null text is empty; rows with a null or repeated doc_id are
documents of their own; of equal texts the row with the smallest doc_id stays
(null is largest, ties by an arbitrary but single row); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import KEY, free_name, prepare, with_key

BLOCK_BYTES = 4096

#: Runs of ASCII white space that are not already one space.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), _RUNS, " ")


def _blocks(block_bytes: int) -> Column:
    return F.expr(
        f"transform(sequence(0, cast(greatest(ceil(n_bytes / {block_bytes}) - 1, 0) as int)),"
        f" i -> substring(bytes, i * {block_bytes} + 1, {block_bytes}))"
    )


def _xx(seed: int, block: Column) -> Column:
    return F.xxhash64(F.lit(seed), block)


def _named(keys: DataFrame, by: list[str], out: list[str]) -> DataFrame:
    """Distinct rows of ``keys``, sorted within hash partitions; a row's integer is
    its partition's offset plus its place."""
    return (
        keys.distinct()
        .sortWithinPartitions(*by)
        .withColumn("name", F.monotonically_increasing_id())
        .select(*out, "name")
        .checkpoint()
    )


def _name_blocks(texts: DataFrame, block_bytes: int, first_seed: int, key=_xx):
    """Names of all distinct blocks as ``(k1, k2, name)``, and the seed that held."""
    blocks = texts.select(F.explode(_blocks(block_bytes)).alias("block"))
    seed = first_seed
    while True:
        keys = blocks.select(
            key(seed, F.col("block")).alias("k1"), key(seed + 1, F.col("block")).alias("k2"), "block"
        )
        names = _named(keys, ["k1", "k2", "block"], ["k1", "k2"])
        if names.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            return names, seed
        seed += 2


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    key=_xx,
    row_col: str | None = None,
) -> DataFrame:
    """``(rid, doc_id, n_bytes, sha binary, name)``: equal (n_bytes, name) iff equal texts."""
    prepare(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"),
        F.encode(normalised(text_col), "UTF-8").alias("bytes"),
    ).withColumn("n_bytes", F.octet_length("bytes").cast("long"))
    names, seed = _name_blocks(texts, block_bytes, 42, key)
    slim = texts.select(
        "rid",
        "doc_id",
        "n_bytes",
        F.unhex(F.sha2("bytes", 256)).alias("sha"),
        F.transform(
            _blocks(block_bytes), lambda b: F.struct(key(seed, b).alias("k1"), key(seed + 1, b).alias("k2"))
        ).alias("keys"),
    ).checkpoint()
    row = ["rid", "doc_id", "n_bytes", "sha"]
    level = (
        slim.select(*row, F.size("keys").alias("left"), F.posexplode("keys").alias("pos", "k"))
        .select(*row, "left", "pos", "k.k1", "k.k2")
        .join(names, ["k1", "k2"])
        .select(*row, "left", "pos", "name")
    )
    longest = slim.agg(F.max(F.size("keys"))).first()[0] or 1
    done = level.filter("left = 1")
    rest = level.filter("left > 1").checkpoint() if longest > 1 else None
    for _ in range(math.ceil(math.log2(longest))):
        pairs = (
            rest.groupBy(*row, "left", F.expr("pos div 2").cast("int").alias("half"))
            .agg(
                F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pair_names = _named(pairs.select("a", "b"), ["a", "b"], ["a", "b"])
        level = (
            pairs.join(pair_names, ["a", "b"])
            .select(
                *row,
                F.ceil(F.col("left") / 2).cast("int").alias("left"),
                F.col("half").alias("pos"),
                "name",
            )
            .checkpoint()
        )
        done = done.unionByName(level.filter("left = 1"))
        rest = level.filter("left > 1")
    return done.select(*row, "name")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    key=_xx,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``row_col`` names a unique long column of ``docs``; it then returns as ``rid``.
    """
    rows = identify(docs, id_col, text_col, block_bytes, key, row_col)
    groups = rows.groupBy("n_bytes", "name").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    ).checkpoint()  # with a plain scan on this side, a hot group's rows can be split
    out = rows.join(groups, ["n_bytes", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "rid",
    )
    return out if row_col else out.drop("rid")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, key = with_key(docs, id_col), free_name(docs, KEY)
    kept = exact_dedup(rows, id_col, text_col, row_col=key).filter("kept").select(F.col("rid").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
