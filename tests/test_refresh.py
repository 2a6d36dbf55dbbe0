import json
import os

from pyspark.sql import functions as F

from tagweave.operators.index import TagConfig, normalize_tags, parse_tags
from tagweave.streaming.edits import attach_events, publish
from tagweave.streaming.refresh import current_matches, gate_by_stored_tick, refresh_step
from tagweave.operators.projects import stream_refs


def test_gate_goldens(spark):
    stored = spark.createDataFrame([(1, 10), (2, 20)], "doc_id long, tick long")
    batch = spark.createDataFrame(
        [(1, 10, False), (2, 21, False), (3, 1, False), (4, 0, True), (1, 10, True)],
        "doc_id long, tick long, force boolean",
    )
    got = sorted((r.doc_id, r.force) for r in gate_by_stored_tick(batch, stored).collect())
    assert got == [(1, True), (2, False), (3, False), (4, True)]


def test_refresh_stream_end_to_end(spark, tmp_dir):
    raw = spark.createDataFrame([("foo\tx.c\tp\tf\tlanguage:C",), ("bar\ty.c\tp\tf\tlanguage:C",)], "line string")
    tags = normalize_tags(parse_tags(raw), TagConfig.uniform(["c"], order="f"))
    src, ticks, out = (os.path.join(tmp_dir, d) for d in ("in", "ticks", "out"))
    os.makedirs(src)
    schema = "doc_id long, lang string, source string, text string, tick long, force boolean"
    batches = [
        [(1, "c", "a.c", "foo bar", 1, False), (2, "c", "y.c", "zzz", 1, False)],
        [(1, "c", "a.c", "foo bar", 1, False), (2, "c", "q.c", "foo", 2, False)],  # doc 1 unchanged: gated
        [(1, "c", "a.c", "nothing", 2, False)],                                      # doc 1 loses its matches
    ]
    q = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
        .writeStream.foreachBatch(refresh_step(tags, ticks, out))
        .option("checkpointLocation", os.path.join(tmp_dir, "ck")).start()
    )
    names = ["doc_id", "lang", "source", "text", "tick", "force"]
    for i, b in enumerate(batches):
        with open(os.path.join(src, f"{i:03d}.json"), "w") as f:
            for row in b:
                f.write(json.dumps(dict(zip(names, row))) + "\n")
        q.processAllAvailable()
        spark.catalog.refreshByPath(ticks)
        spark.catalog.refreshByPath(out)
        cur = sorted((r.doc_id, r.name) for r in current_matches(spark, ticks, out).collect())
        if i == 0:
            assert cur == [(1, "bar"), (1, "foo"), (2, "bar")]
        if i == 1:
            assert cur == [(1, "bar"), (1, "foo"), (2, "foo")]
            processed = {r.doc_id for r in spark.read.parquet(ticks).where("batch_id = 1").collect()}
            assert processed == {2}
    q.stop()
    assert sorted((r.doc_id, r.name) for r in current_matches(spark, ticks, out).collect()) == [(2, "foo")]


def test_publish_and_attach(spark, tmp_dir):
    snap = spark.createDataFrame([(5, "l1\nl2")], "doc_id long, text string")
    ev = attach_events(snap)
    row = ev.collect()[0]
    assert (row.buf, row.ctick, row.op, row.first, row.last, row.lines) == (5, 0, "lines", 0, 1, ["l1", "l2"])
    out = os.path.join(tmp_dir, "pub")
    w = publish(out)
    w(ev, 3)
    w(ev, 3)
    assert spark.read.parquet(out).count() == 1


def test_stream_refs_drop_zero(spark):
    ev = spark.createDataFrame(
        [("c", "u1", "open"), ("c", "u1", "open"), ("c", "u1", "close"), ("c", "u2", "open"), ("c", "u2", "close")],
        "ft string, unit string, op string",
    )
    assert [tuple(r) for r in stream_refs(ev).collect()] == [("c", "u1", 1)]


def test_two_saves_in_one_batch_keep_the_newest(spark, tmp_dir):
    raw = spark.createDataFrame([("foo\tx.c\tp\tf\tlanguage:C",), ("bar\ty.c\tp\tf\tlanguage:C",)], "line string")
    tags = normalize_tags(parse_tags(raw), TagConfig.uniform(["c"], order="f"))
    ticks, out = os.path.join(tmp_dir, "ticks"), os.path.join(tmp_dir, "out")
    schema = "doc_id long, lang string, source string, text string, tick long, force boolean"
    batch = [(1, "c", "a.c", "foo", 1, True), (1, "c", "a.c", "bar", 2, False), (2, "c", "b.c", "foo", None, None)]
    refresh_step(tags, ticks, out)(spark.createDataFrame(batch, schema), 0)
    assert sorted((r.doc_id, r.name) for r in current_matches(spark, ticks, out).collect()) == [(1, "bar"), (2, "foo")]
    assert {r.doc_id: r.tick for r in spark.read.parquet(ticks).collect()} == {1: 2, 2: None}
    from tagweave.streaming.refresh import newest_saves

    got = {r.doc_id: (r.tick, r.force) for r in newest_saves(spark.createDataFrame(batch, schema)).collect()}
    assert got == {1: (2, True), 2: (None, False)}
