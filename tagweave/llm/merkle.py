"""Merkle manifest of a dataset, verified by a recursive climb from every leaf.

Each row is a leaf, the SHA-256 of its fields.  Per group (``tree_col``) the
leaves, in id order, form a binary tree; the roots of the groups, in group
order, form the top tree.  A level's runs of two nodes become the hash of
their hex digests, the last run may have one node.

**Build.** Leaves get their dense place by a range sort (no global window over
rows).  Then ``stride`` levels are built at once: up to 2^stride neighbours
are one group of a shuffle, whose levels are array expressions.  Every node
that starts such a group is stored as a row: its hash, the link to its parent
row ``stride`` levels up (or into the top tree) with the parent's hash, and
the siblings on the way.  ``stride=1`` stores every level.

**Climb.** One Spark recursive query: a leaf starts with its own hash (or a
tampered one); each step joins it with the row it has reached, folds that
row's siblings into the hash, appends them to the proof and follows the parent
link, until there is none.  Upper rows are stored once for each block of
2^stride leaves below them, so that no join key is shared by more leaves than
that: the top of a tree is not a hot key.  With N leaves the query takes
log(N)/stride steps and the rows of all upper levels are about
N * levels / (stride * 2^stride).

Defined cases: a null field is ``-``, an empty text is ``0:``; null ids and
null groups come first; rows with equal ids are ordered by their leaf, and
equal leaves are interchangeable; a lone leaf is its own subroot and its proof
is empty; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import prepare, stage

#: Levels that a stored row spans.
STRIDE = 8

#: ``tree`` of the rows above the group roots.
TOP = -1

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Blocks listed by one array while upper rows are dealt to blocks.
_SPAN = 4096


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Binary SHA-256 of the fields, each ``-`` or its UTF-8 length, ``:`` and value."""
    parts = [
        F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
        for v in fields
    ]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


@dataclass
class Manifest:
    """``leaves``: one stored row per leaf (``leaf``, ``tampered``, payload and the row's link);
    ``nodes``: the upper rows, dealt to blocks of leaves."""

    leaves: DataFrame
    nodes: DataFrame


def _placed(leaves: DataFrame) -> DataFrame:
    """Leaf rows with tree (rank of the group), pos (place in it), first (place in the
    table) and n (leaves of the tree)."""
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("id"), F.col("hash"), F.col("rid")]
    ranged = stage(
        leaves.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("at", 33))
    # One row per range partition and group: the only table that is numbered in one task.
    runs = ranged.groupBy("part", "grp").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("len"))
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)))
    own = Window.partitionBy("grp")
    runs = runs.select(
        "*", F.min("start").over(own).alias("tree_start"), F.sum("len").over(own).alias("n")
    ).withColumn("tree", F.dense_rank().over(Window.orderBy("tree_start")).cast("long") - 1)
    runs = stage(runs.withColumnsRenamed({"part": "_part", "grp": "_grp"}))
    return ranged.join(
        runs, (F.col("part") == F.col("_part")) & F.col("grp").eqNullSafe(F.col("_grp"))
    ).select(
        *leaves.columns,
        "tree",
        (F.col("at") - F.col("low") + F.col("start") - F.col("tree_start")).alias("pos"),
        (F.col("at") - F.col("low") + F.col("start")).alias("first"),
        F.lit(1).cast("long").alias("under"),
        "n",
    )


_HEX = "lower(hex({}))"


def _rows(nodes: DataFrame, level: int, stride: int, payload: Sequence[str]) -> DataFrame:
    """The stored rows of one level: nodes (tree, pos, n, hash, first, under, payload) with
    their siblings up to the parent ``stride`` levels higher, or the root of a smaller tree."""
    extra = "".join(f", '{c}', {c}" for c in payload)
    groups = nodes.groupBy("tree", F.shiftright("pos", stride).alias("up_pos"), "n").agg(
        F.sort_array(F.collect_list(F.expr(
            f"named_struct('pos', pos, 'hash', hash, 'first', first, 'under', under{extra})"
        ))).alias("m"),
        F.min("first").alias("up_first"),
        F.sum("under").alias("up_under"),
    )
    pair = (
        "transform(sequence(0, (size(a) - 1) div 2),"
        " k -> sha2(cast(concat(a[2 * k], coalesce(get(a, 2 * k + 1), '')) as binary), 256))"
    )
    climb = pair.replace("a[", "element_at(t, -1)[").replace("get(a,", "get(element_at(t, -1),").replace(
        "size(a)", "size(element_at(t, -1))"
    )
    groups = groups.select(
        "*",
        F.expr(f"n <= {1 << stride}").alias("last"),
        F.expr(f"case when n = 1 then 0 when n <= {1 << stride} then length(bin(n - 1)) else {stride} end").alias("up"),
    ).select(
        "*",
        F.expr(
            "aggregate(if(up = 0, cast(array() as array<int>), sequence(1, up)),"
            f" array(transform(m, x -> {_HEX.format('x.hash')})), (t, j) -> concat(t, array({climb})))"
        ).alias("t"),
    )
    siblings = (
        "transform(if(up = 0, cast(array() as array<int>), sequence(0, up - 1)), j -> named_struct("
        "'h', unhex(get(t[j], shiftright(i, j) ^ 1)), 'left', shiftright(i, j) % 2 = 1))"
    )
    each = groups.select(
        "tree",
        "n",
        "up_pos",
        "up_first",
        "up_under",
        "last",
        F.expr("unhex(element_at(t, -1)[0])").alias("parent_hash"),
        F.explode(F.expr(f"transform(sequence(0, size(m) - 1), i -> named_struct('m', m[i], 'siblings', {siblings}))")).alias("e"),
    )
    more = F.col("last") & (F.col("tree") == TOP)
    return each.select(
        "tree",
        F.lit(level).alias("level"),
        F.col("e.m.pos").alias("pos"),
        F.col("e.m.hash").alias("hash"),
        F.col("e.m.first").alias("first"),
        F.col("e.m.under").alias("under"),
        F.col("e.siblings").alias("siblings"),
        F.when(more, None).when(F.col("last"), F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("parent_tree"),
        F.when(more, None).when(F.col("last"), F.lit(0)).otherwise(F.lit(level + 1)).cast("int").alias("parent_level"),
        F.when(more, None).when(F.col("last"), F.col("tree")).otherwise(F.col("up_pos")).cast("long").alias("parent_pos"),
        "parent_hash",
        "n",
        "last",
        "up_first",
        "up_under",
        *[F.col(f"e.m.{c}").alias(c) for c in payload],
    )


def _parents(rows: DataFrame, stride: int) -> DataFrame:
    """One node for each group of ``rows``."""
    return rows.where(F.col("pos") % (1 << stride) == 0).select(
        F.col("parent_tree").alias("tree"),
        F.col("parent_pos").alias("pos"),
        F.expr(f"(n + {(1 << stride) - 1}) div {1 << stride}").alias("n"),
        F.col("parent_hash").alias("hash"),
        F.col("up_first").alias("first"),
        F.col("up_under").alias("under"),
    )


def _tree_rows(nodes: DataFrame, most: int, stride: int, payload: Sequence[str]) -> list[DataFrame]:
    """Stored rows of all levels of trees with at most ``most`` leaves."""
    built, level, fields = [], 0, payload
    while True:
        rows = stage(_rows(nodes, level, stride, fields))
        built.append(rows)
        if most <= 1 << stride:
            return built
        nodes, fields = _parents(rows.where(~F.col("last")), stride), ()
        most, level = -(-most >> stride), level + 1


def build_manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    tree_col: str = "lang",
    id_col: str = "doc_id",
    tampered: dict[str, Column] | None = None,
    stride: int = STRIDE,
) -> Manifest | None:
    """The stored rows of the manifest of ``docs``; ``None`` for an empty table.

    ``tampered`` replaces fields in the hash that a leaf starts its climb with.
    """
    prepare(docs.sparkSession)
    changed = [(tampered or {}).get(c, F.col(c)) for c in fields]
    leaves = docs.select(
        F.col(tree_col).cast("string").alias("grp"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in fields]).alias("hash"),
        leaf_digest(changed).alias("start_hash") if tampered else F.lit(None).cast("binary").alias("start_hash"),
    ).withColumn(
        "start_hash", F.when(F.col("start_hash") != F.col("hash"), F.col("start_hash"))
    )
    # The digests are written once; the sort's sample and the sort read no text.
    leaves = stage(leaves.withColumn("rid", F.monotonically_increasing_id()))
    placed = stage(_placed(leaves))
    most, trees = placed.agg(F.max("n"), F.max("tree") + 1).first()
    if most is None:
        return None
    levels = _tree_rows(placed.drop("grp", "rid"), most, stride, ("id", "start_hash"))
    subroots = None
    for rows in levels:
        ended = _parents(rows.where("last"), stride).withColumn("n", F.lit(trees).cast("long"))
        subroots = ended if subroots is None else subroots.unionByName(ended)
    upper = [r.drop("id", "start_hash") for r in levels[1:]] + _tree_rows(subroots, trees, stride, ())
    nodes = upper[0]
    for rows in upper[1:]:
        nodes = nodes.unionByName(rows)
    return Manifest(levels[0], stage(_dealt(nodes, stride)))


def _dealt(nodes: DataFrame, stride: int) -> DataFrame:
    """Each upper row once for every block of 2^stride leaves that it covers."""
    end = F.expr(f"shiftright(first + under - 1, {stride})")
    spans = F.explode(F.sequence(F.shiftright("first", stride), end, F.lit(_SPAN).cast("long")))
    return (
        nodes.select("*", spans.alias("span"), end.alias("block_end"))
        .select("*", F.explode(F.expr(f"sequence(span, least(block_end, span + {_SPAN - 1}))")).alias("block"))
        .select(
            "tree", "level", "pos", "block", "siblings",
            "parent_tree", "parent_level", "parent_pos", "parent_hash",
        )
    )


_FOLD = (
    "aggregate({siblings}, {start}, (f, s) -> sha2(cast(case when s.h is null then f"
    " when s.left then concat(lower(hex(s.h)), f) else concat(f, lower(hex(s.h))) end as binary), 256))"
)
_APPEND = "aggregate({siblings}, {start}, (p, s) -> if(s.h is null, p, concat(p, s.h)))"


def climb(manifest: Manifest, stride: int = STRIDE) -> DataFrame:
    """Per leaf ``(id, leaf, subroot, root, proof, folded_root)``: the digests as hex text,
    ``proof`` the siblings' digests, bottom up, as binary; ``folded_root`` is what the
    climb from the (tampered) leaf arrives at."""
    spark = manifest.leaves.sparkSession
    # Every leaf is written once a step, by design.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    start = "lower(hex(coalesce(start_hash, hash)))"
    done = spark.sql(
        f"""
        WITH RECURSIVE climb (id, leaf, block, tree, level, pos, folded, proof, subroot, root) AS (
          SELECT id, hash, shiftright(first, {stride}), parent_tree, parent_level, parent_pos,
                 {_FOLD.format(siblings='siblings', start=start)},
                 {_APPEND.format(siblings='siblings', start="cast('' as binary)")},
                 if(last, parent_hash, cast(null as binary)), cast(null as binary)
          FROM {{leaves}}
          UNION ALL
          SELECT c.id, c.leaf, c.block, n.parent_tree, n.parent_level, n.parent_pos,
                 {_FOLD.format(siblings='n.siblings', start='c.folded')},
                 {_APPEND.format(siblings='n.siblings', start='c.proof')},
                 coalesce(c.subroot, if(n.parent_tree = {TOP}, n.parent_hash, null)),
                 if(n.parent_tree is null, n.parent_hash, null)
          FROM climb c JOIN {{nodes}} n
            ON c.block = n.block AND c.pos = n.pos AND c.level = n.level AND c.tree = n.tree
        )
        SELECT id, leaf, subroot, root, proof, folded FROM climb WHERE tree IS NULL
        """,
        leaves=manifest.leaves,
        nodes=manifest.nodes,
    )
    return done.select(
        "id",
        F.lower(F.hex("leaf")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lower(F.hex("root")).alias("root"),
        "proof",
        F.col("folded").alias("folded_root"),
    )


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    tree_col: str = "lang",
    id_col: str = "doc_id",
    tampered: dict[str, Column] | None = None,
    stride: int = STRIDE,
) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    manifest = build_manifest(docs, fields, tree_col, id_col, tampered, stride)
    if manifest is None:
        columns = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        empty = docs.select(F.col(id_col).alias("doc_id")).where("false")
        return empty.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in columns.split(", "))])
    return climb(manifest, stride).select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def tampered_counts(id_col: str = "doc_id", count_col: str = "n_chars", every: int = 7) -> dict[str, Column]:
    """Where ``every`` divides the unsigned crc32 of the decimal id, the count is one more."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return {count_col: F.when(hit, F.col(count_col) + 1).otherwise(F.col(count_col))}
