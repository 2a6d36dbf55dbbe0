"""N-gram Jaccard join with MinHash bands of fixed depth and exact verification.

Documents are sets of five-word shingles.  Each of ``TREES`` bands has the
longest prefix, of at most ``MAX_DEPTH`` minimum hashes, with which a pair at
the threshold is found with at least the target recall (:func:`prefix_length`);
two documents are candidates if they share the whole prefix in any band.  Equal
prefixes are nodes, found by one grouping.  This replaces an LSH forest: there
are no sorted tries and nothing is shortened on matched prefixes.

Candidates are verified exactly without writing out pairs.  Documents that
meet in a node are chained to the node's smallest member, the chains'
connected components are clusters, and each cluster is cut into blocks of
``BLOCK`` sets.  A task holds two blocks (one, on the diagonal), counts all
their intersections as a matrix product and returns, per set, its number of
links and its component there.  Equal sets are one node with a weight, so
copies never meet each other.  Blocks keep any cluster's memory bounded;
their number grows with the square of a cluster's blocks, since an exact
count of links has to look at each pair.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z folded.  A text of one to four words
is one shingle.  Shingle sets are compared by 64-bit hashes of the shingles.

Defined cases: null and empty texts have no shingles, no links and a class of
their own; repeated rows are linked documents; a null id sorts last as class
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import KEY, WordHash, free_name, keyed, lean, mix, rolling, with_key, word_arrays
from tagweave.workers import ship_by_value

SHINGLE = 5
THRESHOLD = 0.8
TREES = 40
MAX_DEPTH = 8
TARGET_RECALL = 0.999999
BLOCK = 512
#: Columns of the membership matrix that are multiplied at a time.
SLAB = 8192


def prefix_length(threshold: float, trees: int, max_depth: int, target: float) -> int:
    """Longest prefix at which a pair of that similarity shares a node with the target recall."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    return 1


def shingle_sets(texts: Iterable[str], cache: WordHash, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    hashes, counts = word_arrays(texts, cache, lower=True)
    at = 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        if n:
            own = mix(rolling(own, min(n, width)), np.uint64(min(n, width)))
        yield np.unique(own)


def prefixes(shingles: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The document's node in each trie: hash of its first ``depth`` minimum hashes there."""
    factors = np.random.default_rng(20).integers(0, 1 << 31, trees * depth, dtype=np.uint32)
    factors = factors * np.uint32(2) + np.uint32(1)
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * factors).min(axis=0), out=least)
    least = least.reshape(trees, depth).astype(np.uint64)
    out = np.arange(trees, dtype=np.uint64)
    for k in range(depth):
        out = mix(out, least[:, k])
    return out


def _sign(trees: int, depth: int):
    schema = pa.schema(
        [("key", pa.int64()), ("identity", pa.binary()), ("nodes", pa.list_(pa.int64()))]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        cache = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                identity, nodes = [], []
                for own in shingle_sets(part.column(1).to_pylist(), cache):
                    identity.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    nodes.append(prefixes(own, trees, depth).view(np.int64) if len(own) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(identity, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                    schema=schema,
                )

    return run


def _hash_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, text, weight, cluster, block`` to the same with shingle hashes in place of the text."""
    lean()
    cache = WordHash()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [own.tobytes() for own in shingle_sets(part.column(1).to_pylist(), cache)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sets, pa.binary()), *part.columns[2:]],
                names=["key", "shingles", "weight", "cluster", "block", "blocks"],
            )


def components(links: np.ndarray) -> np.ndarray:
    """Smallest index of each node's connected component in a symmetric boolean matrix."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    a = np.concatenate(left) if left else np.empty(0, np.uint64)
    b = np.concatenate(right) if right else np.empty(0, np.uint64)
    common = np.intersect1d(a, b)
    rows_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rows_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    at_a, at_b = np.searchsorted(common, a), np.searchsorted(common, b)
    if len(common):
        in_a = common[np.minimum(at_a, len(common) - 1)] == a
        in_b = common[np.minimum(at_b, len(common) - 1)] == b
        rows_a, at_a, rows_b, at_b = rows_a[in_a], at_a[in_a], rows_b[in_b], at_b[in_b]
    for low in range(0, len(common), SLAB):
        wide = min(SLAB, len(common) - low)
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        here = (at_a >= low) & (at_a < low + wide)
        x[rows_a[here], at_a[here] - low] = 1
        here = (at_b >= low) & (at_b < low + wide)
        y[rows_b[here], at_b[here] - low] = 1
        out += x @ y.T
    return out


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lean()
        pdf = pdf.sort_values("key", ignore_index=True)
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        block = pdf["block"].to_numpy()
        weight = pdf["weight"].to_numpy(dtype=np.float64)
        first = np.flatnonzero(block == block.min())
        second = np.flatnonzero(block == block.max())
        left, right = [sets[i] for i in first], [sets[i] for i in second]
        both = intersections(left, right)
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        union = sizes[first][:, None] + sizes[second][None, :] - both
        close = both >= threshold * union - 1e-9
        links = np.zeros((len(sets), len(sets)), dtype=bool)
        links[np.ix_(first, second)] = close
        links |= links.T
        np.fill_diagonal(links, False)
        root = components(links)
        counts = links @ weight
        keys = pdf["key"].to_numpy()
        keep = counts > 0
        return pd.DataFrame(
            {"key": keys[keep], "links": counts[keep].astype(np.int64), "root": keys[root[keep]]}
        )

    return run


def connected(edges: DataFrame) -> DataFrame:
    """``(key, root)`` for the nodes of ``edges (a, b)``: the smallest node of each component.

    Alternating large and small stars: each step links a node's neighbours
    to the smallest of them, until every node hangs on its root.
    """
    now = edges.filter("a != b").select("a", "b").distinct().checkpoint()
    before = None
    while True:
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")).checkpoint()
        large = (  # larger neighbours of a node hang on the least of it and its neighbours
            sides.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        large = large.checkpoint()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
        least = down.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        now = (
            down.join(least, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .filter("a != b")
            .distinct()
            .checkpoint()
        )
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct()
            )
        before = state


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = TREES,
    target: float = TARGET_RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """``(key, doc_id, root, links)``: per row its class's smallest key and its number of linked rows."""
    rows = keyed(docs, id_col, text_col)
    depth = prefix_length(threshold, trees, MAX_DEPTH, target)
    signed = (
        rows.select("key", "text")
        .mapInArrow(_sign(trees, depth), "key long, identity binary, nodes array<long>")
        .checkpoint()
    )
    same = (
        signed.filter("identity is not null")
        .groupBy("identity")
        .agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("weight"))
        .checkpoint()
    )
    reps = signed.select("key", "nodes").join(same.select(F.col("rep").alias("key")), "key", "left_semi")
    nodes = reps.select("key", F.explode("nodes").alias("node"))
    heads = nodes.groupBy("node").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = nodes.join(heads.select("node", "head"), "node").select(
        F.col("key").alias("a"), F.col("head").alias("b")
    )
    clusters = connected(edges).checkpoint()
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = (
        clusters.join(sizes.checkpoint(), "root")
        .join(same.select(F.col("rep").alias("key"), "weight"), "key")
        .select(
            "key",
            "weight",
            F.col("root").alias("cluster"),
            F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"),
            "blocks",
        )
    )
    sets = (
        rows.select("key", "text")
        .join(placed, "key")
        .select("key", "text", "weight", "cluster", "block", "blocks")
        .mapInArrow(
            _hash_sets, "key long, shingles binary, weight long, cluster long, block int, blocks int"
        )
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    found = (
        sets.withColumn("other", other)
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .groupBy("cluster", "low", "high")
        .applyInPandas(_verify(threshold), "key long, links long, root long")
        .checkpoint()
    )
    classes = connected(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    by_set = (
        same.join(classes.withColumnRenamed("key", "rep"), "rep", "left")
        .join(links.withColumnRenamed("key", "rep"), "rep", "left")
        .select(
            "identity",
            F.coalesce("root", "rep").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        )
        .checkpoint()
    )
    return (
        rows.select("key", "doc_id")
        .join(signed.select("key", "identity"), "key")
        .join(by_set, "identity", "left")
        .select(
            "key",
            "doc_id",
            F.coalesce("root", "key").alias("root"),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its class), n_links."""
    found = near_duplicates(docs, threshold, id_col, text_col).checkpoint()
    names = found.groupBy("root").agg(F.min("doc_id").alias("class_id")).checkpoint()
    return found.join(names, "root").select("doc_id", "class_id", "n_links")


def drop_near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    rows, key = with_key(docs, id_col), free_name(docs, KEY)
    found = near_duplicates(rows, threshold, key, text_col)
    kept = found.filter("key = root").select(F.col("key").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)


ship_by_value(__name__)
