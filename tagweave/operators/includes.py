"""Include resolution and bounded include closure."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.constants import MAX_HEADER_SEARCH_LEVEL
from tagweave.functions.paths import clean_path, path_join
from tagweave.operators.lines import extract_includes
from tagweave.session import TASKS, cut_lineage
from tagweave.workers import ship_by_value

#: Roots that one task walks together, over one copy of the edges they reach.
PART = 1 << 13
#: Parts of fewer roots there are up to this many, and roots of the smallest ones: few roots keep some cores busy too.
FEW, LEAST = 16, 1 << 8
#: Pairs of a root and a node that a task holds at a time.
CELLS = 1 << 23
#: Rows of an Arrow batch of results.
BATCH = 1 << 16


def resolve_includes(includes: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(doc_id, path)`` for every include that exists.

    ``includes``: ``(doc_id, own_dir, inc, search_dirs array<string>)``;
    ``manifest``: ``(dir, file)`` of existing files.  The including file's own
    directory wins; otherwise every search directory holding the file is
    returned.

    One equi-join: each include is exploded into its candidate directories
    (own directory with priority 0, the other search directories with
    priority 1 -- a short per-row array, never a cross join), joined with the
    manifest on (dir, file), and only the best priority found per include is
    kept.  The per-include window holds at most one row per search directory.
    """
    m = manifest.select("dir", F.col("file").alias("inc")).distinct()
    others = F.array_distinct(F.filter("search_dirs", lambda d: d != F.col("own_dir")))
    cands = F.concat(
        F.array(F.struct(F.col("own_dir").alias("dir"), F.lit(0).alias("prio"))),
        F.transform(others, lambda d: F.struct(d.alias("dir"), F.lit(1).alias("prio"))),
    )
    x = includes.select("doc_id", "own_dir", "inc", F.explode(cands).alias("c")).select(
        "doc_id", "own_dir", "inc", F.col("c.dir").alias("dir"), F.col("c.prio").alias("prio")
    )
    hits = x.join(m, ["dir", "inc"], "inner")
    best = F.min("prio").over(Window.partitionBy("doc_id", "own_dir", "inc"))
    return (
        hits.withColumn("_best", best)
        .where(F.col("prio") == F.col("_best"))
        .select("doc_id", F.concat_ws("/", "dir", "inc").alias("path"))
        .distinct()
    )


def sorted_headers(resolved: DataFrame) -> DataFrame:
    """``(doc_id, headers)``: a document's distinct resolved headers in path order."""
    return resolved.groupBy("doc_id").agg(F.array_sort(F.collect_set("path")).alias("headers"))


def _grow(first: DataFrame, step, keys: list[str], max_depth: int, checkpoint: bool) -> DataFrame:
    """Semi-naive reachability of many roots at once: ``(keys, block, word, depth)``.

    64 roots are the bits of one ``word`` of a ``block``, so a row says which of
    them reach a node.  ``first`` holds the rows of depth 1, ``step`` takes the
    rows of one depth to their successors.  One aggregation a depth (``bit_or``,
    map-side first) adds up the words that arrive at a node and those seen there
    before; bits not seen before are the next depth, so no pair is walked twice.
    The loop ends with an empty depth, after ``max_depth`` (a constant) at most.
    Every depth is written to the reliable checkpoint directory: a lost executor
    costs one depth.
    """
    keep = cut_lineage if checkpoint else (lambda df: df)
    at, none = [*keys, "block"], F.lit(0).cast("long")
    arrived, old, depths = first.withColumn("seen", none), None, []
    for depth in range(1, max_depth + 1):
        if old is not None:
            arrived = step(level).withColumn("seen", none).unionByName(
                old.select(*at, "seen", none.alias("word"))
            )
        sums = arrived.groupBy(*at).agg(F.bit_or("word").alias("_new"), F.bit_or("seen").alias("_old"))
        fresh = F.col("_new").bitwiseAND(F.bitwise_not("_old"))
        old = keep(sums.select(*at, fresh.alias("word"), F.col("_new").bitwiseOR(F.col("_old")).alias("seen")))
        level = old.where(F.col("word") != 0).drop("seen")
        depths.append(level.withColumn("depth", F.lit(depth).cast("bigint")))
        if checkpoint and level.isEmpty():
            break
    return reduce(DataFrame.unionByName, depths)


def _bits(root: str) -> list:
    """Block and word of one integral root."""
    bit = F.expr(f"shiftleft(1L, cast({root} & 63 as int))")
    return [F.shiftright(root, 6).alias("block"), bit.alias("word")]


def _roots(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per bit: ``root`` and ``columns``."""
    bits = rows.select("block", "word", *columns, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_bit"))
    return bits.where(F.expr("shiftright(word, _bit) & 1 = 1")).select(
        (F.shiftleft("block", 6) + F.col("_bit")).alias("root"), *columns
    )


def include_closure(
    roots: DataFrame,
    edges: DataFrame,
    max_depth: int = MAX_HEADER_SEARCH_LEVEL + 1,
    checkpoint: bool = True,
) -> DataFrame:
    """``(root, node, depth)``: nodes reachable from each root (an integer), shortest depth
    1..``max_depth`` (direct includes are depth 1; nodes up to depth 8 are
    expanded, so results reach depth 9).

    Results are some hundred rows a root, so they are not what is stored or shuffled.
    Roots are dealt by hash into parts of ``PART``; :func:`_grow` walks whole parts (64 to
    a word) and finds which nodes each expands.  Every part then gets the edges of its
    nodes once, and one task walks its roots over them and hands the results on.
    """
    keep = cut_lineage if checkpoint else (lambda df: df)
    e = keep(edges.select("src", "dst").distinct())
    r = roots.select(F.col("root").cast("long").alias("root")).where(F.col("root").isNotNull()).distinct()
    count = r.count()
    parts = max(1, -(-count // PART), min(FEW, count // LEAST))
    r = r.select(F.col("root").alias("node"), F.expr(f"pmod(xxhash64(root), {parts}L)").alias("part"))

    def step(level: DataFrame) -> DataFrame:
        return level.join(e, level.node == e.src).select(F.col("dst").alias("node"), "block", "word")

    # The roots themselves are the first rows, so depths here are one more than the distance.
    grown = _grow(r.select("node", *_bits("part")), step, ["node"], max_depth, checkpoint)
    kind, result = grown.schema["node"].dataType, e.schema["dst"].dataType
    held = grown.join(e, grown.node == e.src).select(
        "block", "word", (F.col("depth") == 1).alias("start"), "node", F.col("dst").cast(kind).alias("dst")
    )
    dealt = _roots(held, "start", "node", "dst").withColumnRenamed("root", "part")
    dealt = dealt.repartitionById(parts, F.col("part").cast("int"))
    schema = T.StructType().add("root", T.LongType()).add("node", kind).add("depth", T.LongType())
    return dealt.mapInArrow(_walks(max_depth), schema).select("root", F.col("node").cast(result).alias("node"), "depth")


def _walks(max_depth: int):
    """Of rows ``(part, start, node, dst)``, edges by part, the results of each part's roots: the nodes marked ``start``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        for part in pc.unique(rows["part"]):
            own = rows.filter(pc.equal(rows["part"], part))
            yield from _walk(own["start"], own["node"], own["dst"], max_depth)

    return run


def _walk(start: pa.ChunkedArray, src: pa.ChunkedArray, dst: pa.ChunkedArray, max_depth: int) -> Iterator[pa.RecordBatch]:
    """Breadth-first walks of the sources marked ``start``, as many at a time as ``CELLS`` has room for.

    Nodes are numbers here, and a pair is one number: walk times nodes plus node.
    """
    coded = pa.concat_arrays([*src.chunks, *dst.chunks]).dictionary_encode(null_encoding="encode")
    names, codes = coded.dictionary, coded.indices.to_numpy()
    at, to, n = codes[: len(src)], codes[len(src) :], len(coded.dictionary)
    to = to[np.argsort(at, kind="stable")]
    degree = np.bincount(at, minlength=n)
    begin = np.cumsum(degree) - degree
    roots = np.unique(at[start.to_numpy()])
    many = min(len(roots), max(1, CELLS // max(n, len(to))))
    seen = np.zeros(many * n, bool)
    for first in range(0, len(roots), many):
        mine = roots[first : first + many].astype(np.int64)
        level, found = np.arange(len(mine)) * n + mine, []
        for _ in range(max_depth):
            node = level % n
            count = degree[node]
            ends = np.cumsum(count)
            edge = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[node] - ends + count, count)
            level = np.repeat(level - node, count) + to[edge]
            level = np.sort(level[~seen[level]])
            level = level[np.append(True, level[1:] != level[:-1])[: len(level)]]
            seen[level] = True
            found.append(level)
        pairs = np.concatenate(found)
        seen[pairs] = False
        depth = np.repeat(np.arange(1, len(found) + 1), [len(x) for x in found])
        ids = names.take(pa.array(mine)).cast(pa.int64()).to_numpy()
        for x in range(0, len(pairs), BATCH):
            walk, node = np.divmod(pairs[x : x + BATCH], n)
            columns = [pa.array(ids[walk]), names.take(pa.array(node)), pa.array(depth[x : x + BATCH])]
            yield pa.RecordBatch.from_arrays(columns, names=["root", "node", "depth"])


def _parent_dir(path: str):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolve_paths(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(files' columns, path)`` of every include that exists, among ``files
    (..., own_dir, inc, search array<string>)``: the including file's directory
    wins, otherwise every search directory that has it.  ``inc`` may hold
    directories and ``..``.

    One equi-join with ``manifest (path)``: an include is its short list of
    candidate paths, and only those of the best rank found stay (a window per
    include, as long as the search list).
    """
    own = path_join("own_dir", "inc")
    others = F.array_except(
        F.array_distinct(F.transform("search", lambda d: path_join(d, F.col("inc")))), F.array(own)
    )
    wanted = files.withColumn("_id", F.struct(*files.columns)).select(
        "_id", F.posexplode(F.concat(F.array(own), others)).alias("_at", "path")
    )
    hits = wanted.join(manifest.select("path").distinct(), "path").withColumn("_rank", F.least("_at", F.lit(1)))
    best = F.min("_rank").over(Window.partitionBy("_id"))
    found = hits.withColumn("_best", best).where(F.col("_rank") == F.col("_best"))
    return found.select("_id.*", "path").distinct()


def _above(directory, levels):
    """The directory ``levels`` higher (the root has none above it)."""
    parts = F.split(directory, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(1))), "/")


def header_closure(
    buffers: DataFrame,
    lines: DataFrame,
    max_depth: int = MAX_HEADER_SEARCH_LEVEL + 1,
) -> DataFrame:
    """``(doc_id, path, depth)``: headers that each buffer includes, directly or not.

    ``buffers (doc_id, path, search array<string>)``, ``lines (path, line)`` of
    all files that exist, buffers among them; paths are absolute.  An include is
    looked up next to the file that holds it, then in the search directories of
    the *buffer*, so what a header includes can differ between buffers: a node
    is a header as seen from one list of search directories.

    Which include exists in which directory is one equi-join, made once: every
    file is listed under each end of its path that some include names.  A depth
    then is two equi-joins, with the includes of its files and with that list.
    """
    parts = F.split(F.regexp_replace(clean_path("inc"), "^/", ""), "/")
    inc = extract_includes(lines.select("path", "line")).distinct()
    inc = inc.select(
        F.col("path").alias("src"),
        F.size(F.filter(parts, lambda p: p == "..")).alias("up"),
        F.array_join(F.filter(parts, lambda p: p != ".."), "/").alias("rest"),
    )
    inc = cut_lineage(inc.distinct())
    path = F.split("path", "/")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(path) - 1),
        lambda n: F.struct(
            F.array_join(F.slice(path, F.lit(1), F.size(path) - n), "/").alias("dir"),
            F.array_join(F.slice(path, F.size(path) - n + 1, n), "/").alias("rest"),
        ),
    )
    files = lines.select("path").distinct().select("path", F.explode(ends).alias("e")).select("e.*", "path")
    there = cut_lineage(files.join(inc.select("rest").distinct(), "rest", "left_semi"))
    beside = inc.withColumn("dir", _above(_parent_dir("src"), F.col("up"))).join(there, ["dir", "rest"])
    near = cut_lineage(beside.select("src", "up", "rest", "path").distinct())
    far = cut_lineage(inc.join(near, ["src", "up", "rest"], "left_anti"))
    near = near.select("src", "path").distinct()

    def includes_of(rows: DataFrame) -> DataFrame:
        keep = ["search", "block", "word", F.col("path").alias("node")]
        own = rows.join(near, rows.node == near.src).select(*keep)
        wanted = rows.join(far, rows.node == far.src).select(
            "search", "block", "word", "up", "rest", F.explode("search").alias("d")
        )
        wanted = wanted.withColumn("dir", _above(F.col("d"), F.col("up")))
        return own.unionByName(wanted.join(there, ["dir", "rest"]).select(*keep))

    members = cut_lineage(_numbered(buffers))
    starts = members.select("search", F.explode("nodes").alias("node"), *_bits("number"))
    grown = _grow(includes_of(starts), includes_of, ["search", "node"], max_depth, True)
    # Words meet the buffers of their block before they are taken apart: a row is up to 64
    # results, so rows are dealt by block however few bytes they are.
    of_block = members.groupBy(F.shiftright("number", 6).alias("block")).agg(
        F.collect_list(F.struct(F.expr("cast(number & 63 as int)").alias("bit"), "doc_id")).alias("of")
    )
    set_ = F.expr("filter(of, m -> shiftright(word, m.bit) & 1 = 1)")
    found = grown.repartition(TASKS, "block").join(of_block, "block").select("node", "depth", F.inline(set_))
    return found.select("doc_id", F.col("node").alias("path"), "depth")


def _numbered(buffers: DataFrame) -> DataFrame:
    """``(search, doc_id, nodes, number)``: one row per buffer and search list.  Buffers of
    one list are numbered next to each other, so 64 of them share the words of a walk;
    their own ids would put 64 lists into a block."""
    rows = buffers.where(F.col("doc_id").isNotNull()).groupBy("search", F.col("doc_id").cast("long").alias("doc_id"))
    ordered = rows.agg(F.collect_set("path").alias("nodes")).orderBy("search", "doc_id")
    return ordered.withColumn("number", F.monotonically_increasing_id())


ship_by_value(__name__)
