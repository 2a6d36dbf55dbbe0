"""Registered queries against their SQL, and the pipeline against brute force."""

from collections import Counter

import duckdb
import pytest
from test_dedup import folded, near_classes
from test_scoring import brute_contained

import corpus_pipeline
from tagweave.llm.common import table
from tagweave.llm.packing import TokenIds
from tagweave.llm.common import tokenizer_path
from tagweave.llm.queries import ORACLES, QUERIES
from tagweave.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    frame = QUERIES[key](spark, SF)
    columns = sorted(frame.columns)
    want = con.execute(ORACLES[key])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(
        tuple(r[i] for i in order) for r in want.fetchall()
    )


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_every_row(spark, key):
    frame = QUERIES[key](spark, SF)
    number = "page_id" if key.startswith("op10") else "doc_id"
    source = spark.read.parquet(f"{SF}/{'pages' if number == 'page_id' else 'documents'}.parquet")
    ids = {r[0] for r in source.select(number).collect()}
    rows = frame.collect()
    assert {r[number] for r in rows} == ids and (key.startswith("op6") or len(rows) == len(ids))


def test_pipeline_stages_against_brute_force(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_dir}/{number}")
        out = spark.read.parquet(f"{tmp_dir}/{number}")
        if name == "packing":
            break
        assert out.columns == columns
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
            want = [r for r in held if r[0] not in bad]
        elif name == "exact_dedup":
            first = {}
            for i, text in sorted(held):
                first.setdefault(folded(text), i)
            want = [r for r in held if r[0] in set(first.values())]
        elif name == "near_dedup":
            want = [held[min(c, key=lambda k: held[k][0])] for c in near_classes(held)[1]]
        else:
            items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
            leaks = {k[0] for k in brute_contained(held, items)}
            assert leaks
            want = [r for r in held if r[0] not in leaks]
        assert Counter(tuple(r) for r in out.select("doc_id", "text").collect()) == Counter(want), name
        docs, held = out, want
    ids = TokenIds(tokenizer_path("word_bpe_49k.json"))
    tokens = Counter()
    for r in out.collect():
        tokens[r.doc_id] += r.length
    assert tokens == Counter({i: len(ids.ids(text)) // 4 + 1 for i, text in held})


def test_pipeline_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[0] == "doc_id" and rows.count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
