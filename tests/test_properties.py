import os
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.functions.arrays import splice as native_splice
from tagweave.functions.text import strip_comments
from tagweave.functions.tokens import tokens
from tagweave.operators.edits import splice as py_splice
from tagweave.operators.includes import include_closure

SETTINGS = settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
ALPHABET = "ab_1 \t\n.,;é#\"'/*-"


def python_tokens(text):
    # byte-level identifier scan: [A-Za-z_] then [A-Za-z0-9_]*
    return re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text, flags=re.ASCII)


@SETTINGS
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=60))
def test_tokens_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", tokens("t").alias("k")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == python_tokens(t)


@SETTINGS
@given(st.lists(st.text(alphabet="abc _\t\n.;é", max_size=50), min_size=1, max_size=60))
def test_strip_identity_without_comments(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(strip_comments("t").alias("s"))
    assert [r.s for r in once.collect()] == texts
    twice = once.select(strip_comments("s").alias("s"))
    assert [r.s for r in twice.collect()] == texts


@SETTINGS
@given(
    st.lists(
        st.tuples(
            st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=6),
            st.integers(0, 8),
            st.integers(0, 8),
            st.lists(st.sampled_from(["x", "y", ""]), max_size=4),
        ),
        min_size=1,
        max_size=80,
    )
)
def test_native_splice_random(spark, cases):
    cases = [(a, f, max(f, l), r) for a, f, l, r in cases]
    df = spark.createDataFrame(cases, "a array<string>, f int, l int, r array<string>")
    got = [r.o for r in df.select(native_splice("a", "f", "l", "r").alias("o")).collect()]
    assert got == [py_splice(a, f, l, r) for a, f, l, r in cases]


def test_closure_monotone_in_depth(spark):
    edges = spark.createDataFrame([(i, (i * 3 + 1) % 40) for i in range(40)] + [(i, (i * 7) % 40) for i in range(40)],
                                  "src long, dst long")
    roots = spark.createDataFrame([(0,), (5,)], "root long")
    prev = set()
    for depth in [1, 2, 4, 9]:
        cur = {(r.root, r.node) for r in include_closure(roots, edges, max_depth=depth).collect()}
        assert prev <= cur
        prev = cur
