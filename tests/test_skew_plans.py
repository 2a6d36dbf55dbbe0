import datetime as dt
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagweave.operators.events import active_switch
from tagweave.operators.index import TagConfig, normalize_tags, parse_tags
from tagweave.operators.match import match_tags
from tagweave.operators.patterns import kind_patterns

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_document_and_name_match_brute_force(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    # one document holds most of the text; one name is in almost every document
    docs = [(0, "c", "hot.c", " ".join(rnd.choice(words) for _ in range(20000)))]
    docs += [(i, "c", f"f{i}.c", "w1 " + " ".join(rnd.choice(words) for _ in range(5))) for i in range(1, 200)]
    tag_lines = [f"w{i}\tf{i % 7}.c\tp\t{'cf'[i % 2]}\tlanguage:C" for i in range(0, 300, 3)]
    tag_lines += [f"def{i}\thot.c\tp\tf\tlanguage:C" for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").repartition(3)
    raw = spark.createDataFrame([(x,) for x in tag_lines], "line string")
    tags = normalize_tags(parse_tags(raw), TagConfig.uniform(["c", "c++"], order="cf"))
    got = {tuple(r) for r in match_tags(d, tags).collect()}
    want = set()
    parsed = [ln.split("\t") for ln in tag_lines]
    for doc_id, _, source, text in docs:
        toks = set(text.split())
        for name, file, _, kind, _ in parsed:
            if file == source or name in toks:
                want.add((doc_id, name, kind))
    assert got == want
    pats = {(r.doc_id, r.kind): r.pat for r in kind_patterns(match_tags(d, tags)).collect()}
    hot = sorted((n for (doc, n, k) in want if doc == 0 and k == "f"), key=lambda n: (len(n.encode()), n))
    assert pats[(0, "f")] == "\\|".join(hot)


def test_hot_session_switch_matches_plain_lag(spark):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=rnd.randint(0, 20000)), "view" if rnd.random() < 0.9 else "click",
             rnd.randint(0, 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, session string, buf long")
    got = {r.seq for r in active_switch(df).collect()}
    ordered = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    want, prev = set(), {}
    for seq, ts, sess, buf in ordered:
        if prev.get(sess, None) != buf:
            want.add(seq)
        prev[sess] = buf
    assert got == want


def test_plan_shapes(spark):
    qs = entry.queries()
    for key in ["tag_match", "longest_prefix", "include_resolve", "project_units", "scan_set"]:
        p = plan_of(qs[key](spark, SF))
        assert "NestedLoop" not in p and "Cartesian" not in p, key
    p = plan_of(qs["tag_match"](spark, SF))
    assert "BroadcastHashJoin" in p
    # the document-token side is never the broadcast (build) side
    assert not re.search(r"BroadcastExchange[^\n]*\n[^\n]*Generate explode\(array_distinct", p)
    for key, of in [("active_switch", "event_type"), ("tick_gate", "user_id")]:
        p = plan_of(qs[key](spark, SF))
        assert re.search(rf"hashpartitioning\({of}#\d+L?, _range#\d+", p), key
        assert "NestedLoop" not in p and "Cartesian" not in p, key
    p = plan_of(qs["token_set"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    p = plan_of(qs["admit_buffers"](spark, SF))
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,0)" in p
