import json
import os

from pyspark.sql import functions as F

from tagweave.operators.edits import apply_edit, replay_edits, splice
from tagweave.streaming.edits import EDIT_STREAM_SCHEMA, buffer_states, read_change_stream


def test_splice_goldens():
    assert splice(["a", "b"], 1, 2, ["x", "y"]) == ["a", "x", "y"]
    assert splice(["a", "b"], 0, 0, ["x"]) == ["x", "a", "b"]
    assert splice(["a", "b", "c"], 0, 2, []) == ["c"]
    assert splice(["a"], 1, 1, ["z"]) == ["a", "z"]
    assert splice(["a"], 0, 1, []) == [""]
    assert apply_edit(([""], False), 0, 1, [""]) == ([""], False)
    assert apply_edit(([""], False), 0, 1, ["q"]) == (["q"], True)


def edits_df(spark, rows):
    return spark.createDataFrame(rows, "buf long, ctick long, first int, last int, lines array<string>")


def test_batch_fold(spark):
    df = edits_df(spark, [(1, 1, 0, 0, ["a", "b"]), (1, 2, 1, 2, ["x", "y"]), (1, 3, 0, 1, []), (2, 1, 0, 1, [""])])
    got = {r.buf: (r.text, r.initialized, r.ctick) for r in replay_edits(df, 3).collect()}
    assert got[1] == ("x\ny\n", True, 3)
    assert got[2] == ("", False, 1)


def test_stream_two_microbatches_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    batches = [
        [(1, 1, "lines", 0, 1, ["a", "b"]), (2, 1, "lines", 0, 1, ["p"])],
        [(1, 2, "lines", 1, 2, ["x", "y"]), (1, 1, "lines", 0, 0, ["late"]), (2, 2, "tick", 0, 0, None)],
        [(1, 3, "lines", 0, 1, []), (2, 3, "detach", 0, 0, None)],
    ]
    names = [f.name for f in EDIT_STREAM_SCHEMA.fields]
    stream = spark.readStream.schema(EDIT_STREAM_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    q = (
        buffer_states(stream).writeStream.format("memory").queryName("bufs")
        .outputMode("update").option("checkpointLocation", os.path.join(tmp_dir, "ck")).start()
    )
    for i, b in enumerate(batches):
        with open(os.path.join(src, f"{i:03d}.json"), "w") as f:
            for row in b:
                f.write(json.dumps(dict(zip(names, row))) + "\n")
        q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from bufs").collect()
    current = {}
    for r in rows:
        if r.status == "current":
            current.setdefault(r.buf, []).append((r.ctick, r.text))
    assert max(current[1])[1] == "x\ny"
    assert ("late" in {r.status for r in rows}) and ("detached" in {r.status for r in rows})
    # the same edits as one batch fold give the same final buffer
    flat = [(b, t, f, l, ls) for batch in batches for (b, t, op, f, l, ls) in batch if op == "lines" and not (b == 1 and t == 1 and ls == ["late"])]
    fold = {r.buf: r.text for r in replay_edits(edits_df(spark, flat), 2).collect()}
    assert fold[1] == "x\ny"


def test_result_does_not_depend_on_batch_borders(spark, tmp_dir):
    """Random splits of one edit sequence, with detach and attach, end in the same buffers."""
    import random

    rng = random.Random(12)
    edits, tick = [], 0
    for k in range(30):
        tick += 1
        op = "detach" if k in (9, 20) else "lines"
        if op == "detach":
            edits.append((1, tick, op, 0, 0, None))
        else:
            first = rng.randint(0, 3)
            edits.append((1, tick, op, first, first + rng.randint(0, 2), [f"l{k}"] * rng.randint(0, 2)))
    names = [f.name for f in EDIT_STREAM_SCHEMA.fields]
    results = []
    for trial, cuts in enumerate(([], [9], [10], [5, 10, 21])):
        src = os.path.join(tmp_dir, f"in{trial}")
        os.makedirs(src)
        query = (
            buffer_states(read_change_stream(spark, src, max_files=1)).writeStream.format("memory")
            .queryName(f"split{trial}").outputMode("update")
            .option("checkpointLocation", os.path.join(tmp_dir, f"ck{trial}")).start()
        )
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(edits)])):
            with open(os.path.join(src, f"{i:03d}.json"), "w") as f:
                f.writelines(json.dumps(dict(zip(names, row))) + "\n" for row in edits[a:b])
            query.processAllAvailable()
        query.stop()
        rows = spark.sql(f"select * from split{trial} where status = 'current'").collect()
        results.append(max((r.ctick, r.n_lines, r.text) for r in rows))
        assert spark.sql(f"select * from split{trial} where status = 'detached'").count() == 2
    assert len(set(results)) == 1 and results[0][0] == 30


def test_attach_edit_detach_stream(spark, tmp_dir):
    from tagweave.operators.projects import stream_refs
    from tagweave.streaming.edits import attached_edits, seen_files

    snap, src = os.path.join(tmp_dir, "snap"), os.path.join(tmp_dir, "in")
    os.makedirs(snap)
    os.makedirs(src)
    with open(os.path.join(snap, "0.json"), "w") as f:
        f.write(json.dumps({"doc_id": 7, "text": "a\nb"}) + "\n")
    names = [f.name for f in EDIT_STREAM_SCHEMA.fields]
    with open(os.path.join(src, "0.json"), "w") as f:
        f.write(json.dumps(dict(zip(names, (7, 1, "lines", 1, 2, ["c"])))) + "\n")
    stream = attached_edits(
        spark.readStream.schema("doc_id long, text string").json(snap), read_change_stream(spark, src)
    )
    query = (
        buffer_states(stream).writeStream.format("memory").queryName("attached")
        .outputMode("update").option("checkpointLocation", os.path.join(tmp_dir, "ck")).start()
    )
    query.processAllAvailable()
    query.stop()
    assert [r.text for r in spark.sql("select * from attached where status = 'current'").collect()] == ["a\nc"]
    life = spark.createDataFrame(
        [("open", "c", "u", "f1"), ("open", "c", "u", "f2"), ("detach", "c", "u", "f1")], "op string, ft string, unit string, filename string"
    )
    assert [r.filename for r in seen_files(life).collect()] == ["f1"]
    closes = life.withColumn("op", F.regexp_replace("op", "detach", "close"))
    assert [r.refs for r in stream_refs(closes).collect()] == [1]


def run_split(spark, tmp_dir, name, events, cuts, **options):
    """The change log cut into micro-batches; each one's events shuffled, as nothing keeps their order."""
    import random

    names = [f.name for f in EDIT_STREAM_SCHEMA.fields]
    src = os.path.join(tmp_dir, name)
    os.makedirs(src)
    query = (
        buffer_states(read_change_stream(spark, src, max_files=1), **options).writeStream.format("memory")
        .queryName(name).outputMode("update").option("checkpointLocation", os.path.join(tmp_dir, f"ck{name}")).start()
    )
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(events)])):
        rows = events[a:b]
        random.Random(i).shuffle(rows)
        with open(os.path.join(src, f"{i:03d}.json"), "w") as f:
            f.writelines(json.dumps(dict(zip(names, row))) + "\n" for row in rows)
        query.processAllAvailable()
    query.stop()
    return spark.sql(f"select * from {name}").collect()


def test_attach_after_detach_in_every_split(spark, tmp_dir):
    life = [
        ("lines", 0, 0, 1, ["a", "b"]), ("lines", 3, 1, 2, ["c"]), ("lines", 2, 0, 1, ["late"]), ("detach", 4, 0, 0, None),
        ("lines", 0, 0, 1, ["again"]), ("lines", 1, 1, 1, ["more"]), ("tick", 2, 0, 0, None),
    ]
    events = [(1, tick, op, first, last, lines, k) for k, (op, tick, first, last, lines) in enumerate(life)]
    for trial, cuts in enumerate(([], [4], [5], [1, 2, 3, 4, 5, 6], [3, 6])):
        rows = run_split(spark, tmp_dir, f"again{trial}", events, cuts)
        last = [r for r in rows if r.status == "current"][-1]
        assert (last.ctick, last.text, last.n_lines) == (2, "again\nmore", 2)
        assert sorted(r.status for r in rows if r.status != "current") == ["detached", "late"]


def test_idle_buffers_leave_the_state(spark, tmp_dir):
    import time

    src = os.path.join(tmp_dir, "idle")
    os.makedirs(src)
    names = [f.name for f in EDIT_STREAM_SCHEMA.fields]
    with open(os.path.join(src, "0.json"), "w") as f:
        f.writelines(json.dumps(dict(zip(names, (i, 1, "lines", 0, 1, ["x"], 0)))) + "\n" for i in range(3))
    query = (
        buffer_states(read_change_stream(spark, src), idle_ms=1).writeStream.outputMode("update")
        .format("memory").queryName("idle").option("checkpointLocation", os.path.join(tmp_dir, "ckidle")).start()
    )
    try:
        for _ in range(60):  # the query goes on by itself: time-outs need no new events
            time.sleep(0.5)
            if spark.sql("select * from idle where status = 'expired'").count() == 3:
                break
    finally:
        query.stop()
    rows = spark.sql("select buf, status from idle").collect()
    assert sorted(map(tuple, rows)) == [(i, s) for i in range(3) for s in ("current", "expired")]
