import random

from pyspark.sql import functions as F

from tagweave.functions.text import collapse_blanks, strip_comments
from tagweave.functions.tokens import tokens, vim_tokens
from tagweave.operators.lines import extract_includes
from tagweave.operators.regions import drop_if0


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr("t").alias("r")).collect()[0].r


def test_tokens(spark):
    assert one(spark, tokens, "a1 _b 9c é-d") == ["a1", "_b", "c", "d"]
    assert sorted(one(spark, vim_tokens, "s:foo bar:")) == sorted(["s:foo", "bar:", "foo", ""])


def test_strip_golden(spark):
    src = 'int a; /* c "x" */ char *s = "he//llo \\" q"; // tail\nint b = \'"\'; /* multi\nline */ foo();'
    assert one(spark, strip_comments, src) == "int a;   char *s =  ;  \nint b =  ;   foo();"


def test_strip_huge_literal_no_stack_overflow(spark):
    src = '"' + "x\\n" * 300_000 + '" a /*' + "y" * 600_000 + "*/ b"
    assert one(spark, strip_comments, src) == "  a   b"


def test_collapse_blanks(spark):
    assert one(spark, collapse_blanks, "\t  a  \t b   c\n  d \t\te") == "\t  a b c\n  d e"


def simulate_if0(lines, is_c=True):
    depth, keep = 0, []
    for ln in lines:
        s = ln.lstrip(" \t")
        rest = s[1:].lstrip(" \t") if s.startswith("#") else None
        if depth > 0:
            if rest is not None:
                depth += 1 if rest.startswith("if") else -1 if rest.startswith("endif") else 0
        elif is_c and rest is not None and rest.startswith("if 0"):
            depth = 1
        else:
            keep.append(ln)
    return keep


def run_if0(spark, docs):
    rows = [(d, "c", i, ln) for d, lines in docs.items() for i, ln in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, line_no int, line string")
    out = {}
    for r in drop_if0(df).orderBy("doc_id", "line_no").collect():
        out.setdefault(r.doc_id, []).append(r.line)
    return {d: out.get(d, []) for d in docs}


def test_if0_golden(spark):
    doc = "#if 0,a,#if X,b,#endif,c,#endif,d,# if 0,e,#endif,f".split(",")
    assert run_if0(spark, {1: doc})[1] == ["d", "f"]


def test_if0_random_matches_simulation(spark):
    rnd = random.Random(7)
    pool = ["#if 0", "  # if 0", "#ifdef X", "#endif", "#else", "x", "y", "#include <a>", "#endif // z"]
    docs = {d: [rnd.choice(pool) for _ in range(rnd.randint(0, 30))] for d in range(200)}
    got = run_if0(spark, docs)
    for d, lines in docs.items():
        assert got[d] == simulate_if0(lines), d


def test_include_extract(spark):
    rows = ['#  include "d/x.h" // y', ' #include "a.h"', '#include ""', "#include <s.h>", "#includefoo", "int x;"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "line_no int, line string")
    got = [(r.line_no, r.inc) for r in extract_includes(df).orderBy("line_no").collect()]
    assert got == [(0, "d/x.h"), (3, "s.h")]
