from pyspark.sql import functions as F

from tagweave.operators.index import TagConfig, normalize_tags, parse_tags, quarantine_tags
from tagweave.operators.match import match_tags
from tagweave.operators.patterns import kind_patterns

T = "\t"


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def test_parse_goldens(spark):
    raw = lines(spark, [
        f"foo{T}a.c{T}/^x$/;\"{T}f{T}language:C",
        "!_TAG_FILE_FORMAT\t2",
        "",
        f"foo{T}a.c{T}/^x$/;\"",
        "foo",
        f"bar{T}b.c{T}/^x$/;\"{T}f{T}language:C\r",
        f"baz{T}a{T}7{T}f{T}language:C",
    ])
    got = {tuple(r) for r in parse_tags(raw).collect()}
    assert got == {("foo", "a.c", "f", "c"), ("bar", "b.c", "f", "c"), ("baz", "a", "f", "c")}
    assert [r.line for r in quarantine_tags(raw).collect()] == ["foo"]


def test_normalize_and_match(spark):
    cfg = TagConfig.uniform(["c", "c++", "py"], order="cf", equiv={"t": "c"}, ignored=["skip"])
    raw = lines(spark, [
        f"Alpha{T}x.c{T}p{T}t{T}language:C",      # t -> c, C family
        f"beta{T}y.c{T}p{T}f{T}language:C++",
        f"skip{T}y.c{T}p{T}f{T}language:C",       # ignored name
        f"gamma{T}z.py{T}p{T}v{T}language:Py",    # kind not admitted
        f"delta{T}z.py{T}p{T}f{T}language:Py",
    ])
    tags = normalize_tags(parse_tags(raw), cfg)
    docs = spark.createDataFrame(
        [(1, "c", "x.c", "int beta; /* Alpha */"), (2, "c++", "q.cc", "Alpha beta"), (3, "py", "z.py", "nothing")],
        "doc_id long, lang string, source string, text string",
    )
    got = {tuple(r) for r in match_tags(docs, tags).collect()}
    # doc 1: Alpha defined in its file (even though only in a comment), beta by token
    # doc 2: c++ buffer takes C tags; doc 3: defined in file
    assert got == {(1, "Alpha", "c"), (1, "beta", "f"), (2, "Alpha", "c"), (2, "beta", "f"), (3, "delta", "f")}


def test_pattern_order(spark):
    m = spark.createDataFrame(
        [(1, "f", n) for n in ["bb", "a", "ccc", "c", "B"]], "doc_id long, kind string, name string"
    )
    row = kind_patterns(m).collect()[0]
    assert row.pat == "B\\|a\\|c\\|bb\\|ccc" and row.n == 5


def test_match_unchanged_by_partitioning(spark):
    import __spark_entry__ as e

    q = e.queries()["tag_match"]
    a = q(spark, "/root/testdata/sf0.001")
    b = a.repartition(7, "kind")
    assert sorted(a.collect()) == sorted(b.collect())


def test_vim_buffers_use_vim_tokens(spark):
    cfg = TagConfig.uniform(["vim"], order="f")
    raw = lines(spark, [f"s:helper{T}other.vim{T}p{T}f{T}language:Vim", f"helper{T}x.vim{T}p{T}f{T}language:Vim"])
    docs = spark.createDataFrame([(1, "vim", "a.vim", "call s:helper()")], "doc_id long, lang string, source string, text string")
    got = {tuple(r) for r in match_tags(docs, normalize_tags(parse_tags(raw), cfg)).collect()}
    assert got == {(1, "s:helper", "f"), (1, "helper", "f")}
