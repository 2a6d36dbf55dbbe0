"""Composed edit runs against one sequential fold."""

import random

from pyspark.sql import functions as F

from tagweave.operators.edits import LineCount, apply_edit, apply_pieces, replay_edits, to_pieces


def some_edits(rng, count, wide=12):
    out = []
    for _ in range(count):
        first = rng.choice([0, 0, rng.randint(0, wide)])
        last = rng.choice([first, first + 1, first + rng.randint(0, wide), rng.randint(0, 3)])
        out.append((first, last, [rng.choice(["", "a", "bb"]) for _ in range(rng.choice([0, 0, 1, 1, 2, 4]))]))
    return out


def fold(lines, edits):
    state = (lines, False)
    for e in edits:
        state = apply_edit(state, *e)
    return state


def test_line_count_and_pieces_for_any_start():
    for seed in range(200):
        rng = random.Random(seed)
        edits = some_edits(rng, rng.randint(1, 25))
        count = LineCount()
        for e in edits:
            count.edit(*e)
        for n in range(1, 40):
            start = [f"s{i}" for i in range(n)]
            want, init = fold(start, edits)
            assert count(n) == len(want)
            pieces = to_pieces(fold(list(range(n)), edits)[0])
            assert apply_pieces(start, pieces) == want


def test_pieces_compose():
    for seed in range(200):
        rng = random.Random(seed)
        a, b = some_edits(rng, 9), some_edits(rng, 9)
        start = [f"s{i}" for i in range(rng.randint(1, 9))]
        middle = fold(start, a)[0]
        second = to_pieces(fold(list(range(len(middle))), b)[0])
        first = to_pieces(fold(list(range(len(start))), a)[0])
        both = to_pieces(apply_pieces(apply_pieces(list(range(len(start))), first), second))
        assert apply_pieces(start, both) == fold(start, a + b)[0]


def test_hot_buffer_over_many_tasks(spark):
    """A third of all edits in one buffer, ties on the tick, blank and null replacements."""
    rng = random.Random(9)
    rows = []
    for k in range(1500):
        buf = 7 if k % 3 == 0 else rng.randint(100, 160)
        first, last, lines = some_edits(rng, 1, 30)[0]
        rows.append((buf, k // 4, k, first, last, None if not lines and k % 2 else lines))
    rows.append((500, 1, 1, 0, 1, [""]))
    rows.append((None, 1, 1, 0, 1, ["x"]))
    df = spark.createDataFrame(rows, "buf long, ctick long, seq long, first int, last int, lines array<string>")
    df = df.repartition(5).withColumn("rank", F.lit("clash")).withColumn("pieces", F.lit(1))
    got = {r.buf: (r.ctick, r.n_lines, r.text, r.initialized) for r in replay_edits(df, 24, seq="seq").collect()}
    want = {}
    for buf, tick, _, first, last, lines in rows:
        if buf is not None:
            _, state = want.get(buf, (0, ([""], False)))
            want[buf] = (tick, apply_edit(state, first, last, lines or []))
    assert got == {b: (t, len(x), "\n".join(x), i) for b, (t, (x, i)) in want.items()}
    parts = df.where("buf is not null").repartitionByRange(24, "buf", "ctick", "seq")
    assert parts.where("buf = 7").select(F.spark_partition_id()).distinct().count() >= 7


def test_no_edits(spark):
    empty = spark.createDataFrame([], "buf long, ctick long, first int, last int, lines array<string>")
    assert replay_edits(empty).collect() == []
