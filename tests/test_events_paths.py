import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagweave.operators.events import coerce_props
from tagweave.operators.includes import include_closure, resolve_includes
from tagweave.operators.ordered import hot_splitters, ordered_lag
from tagweave.operators.projects import longest_prefix


def test_ordered_lag_matches_window_lag(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=rnd.randint(0, 3000)), rnd.choice([1, 2, 2, 2, 3]), rnd.randint(0, 5))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, key long, v long")
    got = ordered_lag(df, ["key"], ["ts", "seq"], ["v"], tasks=64)
    want = df.withColumn("w", F.lag("v").over(Window.partitionBy("key").orderBy("ts", "seq")))
    a = {(r.seq, r.prev_v, r.has_prev) for r in got.collect()}
    b = {(r.seq, r.w, r.w is not None) for r in want.collect()}
    assert a == b


def test_ordered_lag_with_nulls_and_one_hot_instant(spark):
    """Null keys and values, and a third of all rows at one instant of one key."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 7, 7, rnd.randint(0, 50)]), rnd.choice(["a", "a", None, "b"]), rnd.choice([None, 1, 2]))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, ts long, key string, v long")
    got = ordered_lag(df, ["key"], ["ts", "seq"], ["v"], tasks=48)
    w = Window.partitionBy("key").orderBy("ts", "seq")
    want = df.withColumn("w", F.lag("v").over(w)).withColumn("n", F.row_number().over(w))
    a = sorted((r.seq, str(r.prev_v), r.has_prev) for r in got.collect())
    assert a == sorted((r.seq, str(r.w), r.n > 1) for r in want.collect())
    assert ordered_lag(df.where("seq < 0"), ["key"], ["ts", "seq"], ["v"]).collect() == []


def test_ranges_of_a_hot_key_are_even(spark):
    """Nine in ten rows are of one key, half of these at one instant; no range is twice the mean."""
    rows = spark.range(40000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("key"),
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") * F.col("id")).alias("ts"),
    )
    tasks = 20
    splits = hot_splitters(rows, ["key"], ["ts", "seq"], tasks).collect()
    assert [r.key for r in splits] == [-1]
    places = sorted((r.ts, r.seq) for r in rows.where("key = -1").collect())
    cuts = [(s.ts, s.seq) for s in splits[0].splits]
    assert cuts == sorted(set(cuts)) and len(cuts) <= tasks
    sizes = [sum(a <= p < b for p in places) for a, b in zip([(-1, -1), *cuts], [*cuts, (1 << 62, 0)])]
    assert sum(sizes) == len(places) and max(sizes) < 2 * 40000 / tasks


def test_bool_coercion_and_map_last_win(spark):
    df = spark.createDataFrame([('{"k": 0}',), ('{"k": 1}',), ('{"k": 2}',), ('{"k": 1, "k": 2}',)], "props string")
    got = [r.k_bool for r in coerce_props(df).collect()]
    assert got == [False, True, None, None]


def test_longest_prefix(spark):
    paths = spark.createDataFrame([("/p/q/r",), ("/z",)], "path string")
    roots = spark.createDataFrame([("/p",), ("/p/q",), ("",)], "root string")
    got = {r.path: r.root for r in longest_prefix(paths, "path", roots).collect()}
    assert got == {"/p/q/r": "/p/q", "/z": "/z"}


def test_include_precedence_and_fallback(spark):
    inc = spark.createDataFrame(
        [(1, "own", "a.h", ["root", "other", "own"]), (2, "own", "b.h", ["root", "other", "own"])],
        "doc_id long, own_dir string, inc string, search_dirs array<string>",
    )
    man = spark.createDataFrame(
        [("own", "a.h"), ("root", "a.h"), ("root", "b.h"), ("other", "b.h")], "dir string, file string"
    )
    got = sorted(tuple(r) for r in resolve_includes(inc, man).collect())
    assert got == [(1, "own/a.h"), (2, "other/b.h"), (2, "root/b.h")]


def test_closure_cycle_and_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)] + [(i, i + 1) for i in range(10, 25)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (10,)], "root long")
    got = {(r.root, r.node): r.depth for r in include_closure(roots, edges).collect()}
    assert got[(1, 2)] == 1 and got[(1, 1)] == 2 and got[(1, 3)] == 2
    assert max(d for (r, n), d in got.items() if r == 10) == 9 and (10, 20) not in got


def test_clean_path_goldens(spark):
    from tagweave.functions.paths import clean_path

    cases = {
        "/a/b/c/d/e/f/../../../../../../x": "/x", "/../x": "/x", "../../x": "../../x", "a/../..": "..",
        "": ".", "/": "/", "a/./b//c/": "a/b/c", "a/..": ".", "/..": "/", "...": "...",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.c for r in df.select("p", clean_path("p").alias("c")).collect()} == cases


def test_longest_prefix_keeps_repeated_rows(spark):
    from tagweave.operators.projects import longest_prefix

    rows = spark.createDataFrame([("/a/b",), ("/a/b",), ("/z",), (None,)], "dir string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("",), (None,)], "root string")
    got = sorted((str(r.dir), str(r.root)) for r in longest_prefix(rows, "dir", roots).collect())
    assert got == [("/a/b", "/a/b"), ("/a/b", "/a/b"), ("/z", "/z"), ("None", "None")]


def test_dead_code_is_not_matched(spark):
    from tagweave.operators.match import document_tokens, match_stats

    text = "#if 0\n dead();\n#endif\nlive(); /* gone */"
    docs = spark.createDataFrame([(1, "c", text), (2, "java", text), (3, "c", "a")], "doc_id long, lang string, text string")
    got = {}
    for r in document_tokens(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.name)
    assert got == {1: {"live"}, 2: {"if", "dead", "endif", "live"}, 3: {"a"}}
    none = spark.createDataFrame([], "doc_id long, name string, kind string")
    assert {r.doc_id: r.total_tokens for r in match_stats(docs, none).collect()} == {1: 1, 2: 4, 3: 1}


def test_scan_set_reads_files_that_are_not_open(spark):
    from tagweave.operators.projects import scan_set

    units = spark.createDataFrame(
        [(1, "go", "/p", "/p/a.go", False, True), (2, "c", "/q/x.c", "/q/x.c", True, True)],
        "doc_id long, ft string, unit string, filename string, is_c boolean, recurse boolean",
    )
    headers = spark.createDataFrame([(2, "/q/x.h")], "doc_id long, path string")
    tree = spark.createDataFrame(
        [("/p/a.go", "go"), ("/p/d/b.go", "go"), ("/p/c.py", "python"), ("/pp/z.go", "go")], "path string, ft string"
    )
    got = {tuple(r) for r in scan_set(units, headers, tree).collect()}
    assert got == {("go", "/p", "/p/a.go"), ("go", "/p", "/p/d/b.go"), ("c", "/q/x.c", "/q/x.c"), ("c", "/q/x.c", "/q/x.h")}
