"""Header closure from file texts against a plain walk."""

import posixpath
import random
from collections import deque
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagweave.operators import includes
from tagweave.operators.includes import header_closure, include_closure, resolve_paths
from tagweave.session import ensure_checkpoint_dir

FILES = {
    "/p/src/a.c": ['#include "x.h"', '#include "sub/y.h"', ' #include "z.h"', "int a;"],
    "/p/src/b.c": ['#  include <../inc/x.h>', '#include "none.h"', '#include "x.h"'],
    "/p/src/sub/x.h": ['#include "y.h"'],
    "/p/src/sub/y.h": ['#include "../a.c"', '#include "deep.h"'],
    "/p/inc/x.h": ['#include "y.h"', '#include "../inc/../inc/x.h"'],
    "/p/inc/y.h": ['#include "deep.h"'],
    "/p/inc/deep.h": [],
    "/p/src/deep.h": ['#include "../../../../q.h"'],
    "/q.h": ['#include ""', '#include ".."'],
    "/other/x.h": [],
}
SEARCH = {"/p/src/a.c": ["/p/inc", "/p/src"], "/p/src/b.c": ["/other", "/p/inc"]}


def walk(files, start, search, max_depth=9):
    """Shortest depth of every header, one file at a time."""
    depth, queue = {}, deque([(start, 0)])
    expanded = set()
    while queue:
        at, d = queue.popleft()
        if at in expanded or d == max_depth:
            continue
        expanded.add(at)
        for line in files[at]:
            rest = line[1:].lstrip(" \t") if line.startswith("#") else ""
            rest = rest[7:].lstrip(" \t") if rest.startswith("include") else ""
            close = {'"': '"', "<": ">"}.get(rest[:1])
            name = rest[1 : rest.index(close, 1)] if close and close in rest[1:] else ""
            if not name:
                continue
            own = posixpath.normpath(posixpath.dirname(at) + "/" + name)
            found = [own] if own in files else sorted({posixpath.normpath(s + "/" + name) for s in search} & set(files))
            for path in found:
                depth.setdefault(path, d + 1)
                queue.append((path, d + 1))
    return depth


def run(spark, files, search):
    lines = spark.createDataFrame([(p, x) for p, xs in files.items() for x in xs or [""]], "path string, line string")
    names = sorted(search)
    buffers = spark.createDataFrame([(i * 67 - 70, p, search[p]) for i, p in enumerate(names)], "doc_id long, path string, search array<string>")
    buffers = buffers.unionByName(buffers.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = {}
    for r in header_closure(buffers, lines).collect():
        assert (r.doc_id, r.path) not in got
        got[r.doc_id, r.path] = r.depth
    want = {(i * 67 - 70, h): d for i, p in enumerate(names) for h, d in walk(files, p, search[p]).items()}
    assert got == want and want


def test_golden_tree(spark):
    run(spark, FILES, SEARCH)


def test_random_trees(spark):
    rng = random.Random(3)
    dirs = ["/w", "/w/a", "/w/b", "/w/a/c"]
    paths = [f"{rng.choice(dirs)}/f{i}.h" for i in range(40)] + [f"{d}/same.h" for d in dirs]
    forms = ['#include "{}"', '#  include <{}> // x', ' #include "{}"']
    names = [p.rsplit("/", 1)[1] for p in paths] + ["a/same.h", "../same.h", "c/../same.h", "./same.h", "no.h"]
    files = {p: [rng.choice(forms).format(rng.choice(names)) for _ in range(rng.randint(0, 3))] for p in paths}
    run(spark, files, {p: rng.sample(dirs, 2) for p in rng.sample(paths, 9)})


def test_resolve_paths_keeps_precedence(spark):
    files = spark.createDataFrame(
        [(1, "/p/src", "x.h", ["/other", "/p/inc"]), (2, "/p/inc", "x.h", ["/other"]), (3, "/p", "no.h", ["/p"])],
        "id long, own_dir string, inc string, search array<string>",
    )
    manifest = spark.createDataFrame([(p,) for p in FILES], "path string")
    got = sorted((r.id, r.path) for r in resolve_paths(files, manifest).collect())
    assert got == [(1, "/other/x.h"), (1, "/p/inc/x.h"), (2, "/p/inc/x.h")]


def test_closure_packs_roots(spark):
    """Roots below zero, beyond a block and unknown ones; 64 of them are one row."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(-3, 140)] + [(5, 5), (7, -3)], "src long, dst long")
    roots = spark.createDataFrame([(r,) for r in [*range(-3, 130), 999, None, 4]], "root long")
    got = {(r.root, r.node): r.depth for r in include_closure(roots, edges).collect()}
    step = {}
    for a, b in [(i, i + 1) for i in range(-3, 140)] + [(5, 5), (7, -3)]:
        step.setdefault(a, set()).add(b)
    want = {}
    for root in range(-3, 130):
        level = {root}
        for depth in range(1, 10):
            level = {b for a in level for b in step.get(a, ())}
            for node in level:
                want.setdefault((root, node), depth)
    assert got == want


def closure(roots, edges, max_depth=9):
    """``{(root, node): depth}`` of a plain walk."""
    step, want = {}, {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for root in {r for r in roots if r is not None}:
        level = {root}
        for depth in range(1, max_depth + 1):
            level = {b for a in level if a is not None for b in step.get(a, ()) if (root, b) not in want}
            want.update({(root, b): depth for b in level})
    return want


@pytest.mark.parametrize("part, cells", [(7, 1), (30, 400), (1 << 13, 1 << 23)])
def test_closure_of_scattered_ids(spark, monkeypatch, part, cells):
    """Ids far apart, null and repeated ones, hubs, loops and dead ends, in many parts or one, at several depths."""
    monkeypatch.setattr(includes, "PART", part, raising=False)
    monkeypatch.setattr(includes, "CELLS", cells, raising=False)
    monkeypatch.setattr(includes, "BATCH", 3, raising=False)
    rng = random.Random(8)
    ids = [rng.randint(-(2**62), 2**62) for _ in range(90)]
    edges = [(a, rng.choice(ids[:9] if rng.random() < 0.5 else ids)) for a in ids[5:] for _ in range(rng.randint(0, 4))]
    edges += [*edges[:20], (ids[6], None), (None, ids[6]), (None, None), (ids[7], ids[7]), (ids[8], 12345)]
    roots = [*ids, *ids[:10], None, 777, 12345]
    e = spark.createDataFrame(edges, "src long, dst long")
    r = spark.createDataFrame([(x,) for x in roots], "root long")
    for depth, checkpoint in ((9, True), (1, True), (3, False)):
        rows = include_closure(r, e, depth, checkpoint).collect()
        assert {(x.root, x.node): x.depth for x in rows} == closure(roots, edges, depth)
        assert len(rows) == len(closure(roots, edges, depth))


def test_closure_keeps_the_kind_of_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst int")
    roots = spark.createDataFrame([(1,)], "root int")
    found = include_closure(roots, edges)
    assert found.dtypes == [("root", "bigint"), ("node", "int"), ("depth", "bigint")]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 1), (1, 3, 2)]


def test_closure_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    some = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert include_closure(spark.createDataFrame([(1,)], "root long"), none).collect() == []
    assert include_closure(spark.createDataFrame([(None,)], "root long"), some).collect() == []


def test_closure_does_not_store_its_results(spark):
    """Bytes kept for a walk follow from roots and edges, not from the pairs of root and node."""
    n = 2000
    edges = spark.createDataFrame([(i, (2 * i + 1) % n) for i in range(n)] + [(i, i * i % 997) for i in range(n)], "src long, dst long")
    size = lambda: sum(f.stat().st_size for f in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("part-*"))
    before = size()
    rows = include_closure(spark.range(n).withColumnRenamed("id", "root"), edges).count()
    assert rows > 300 * n and size() - before < 2 * rows


def test_buffers_of_one_search_list_share_blocks(spark):
    """Ids alternate between lists; 64 buffers of a list are still one word, and results stay theirs."""
    n = 400
    lists = [["/p/inc", "/p/src"], ["/other", "/p/inc"], ["/p/src"], ["/none"]]
    rows = [(i, "/p/src/a.c", lists[i % 4]) for i in range(n)] + [(4, "/p/src/b.c", lists[0]), (5, "/p/src/b.c", lists[0]), (None, "/p/src/a.c", lists[0])]
    buffers = spark.createDataFrame(rows, "doc_id long, path string, search array<string>")
    lines = spark.createDataFrame([(p, x) for p, ls in FILES.items() for x in ls or [""]], "path string, line string")
    numbered = includes._numbered(buffers).select("search", F.shiftright("number", 6).alias("block"))
    assert numbered.distinct().count() <= 16 < n // 4
    got = sorted(tuple(r) for r in header_closure(buffers, lines).collect())
    want = []
    for search in lists:
        for i in {r[0] for r in rows if r[0] is not None and r[2] == search}:
            best = {}
            for start in {r[1] for r in rows if r[0] == i and r[2] == search}:
                for path, d in walk(FILES, start, search).items():
                    best[path] = min(d, best.get(path, 99))
            want += [(i, path, d) for path, d in best.items()]
    assert got == sorted(want)
