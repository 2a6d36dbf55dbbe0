"""Structured Streaming: keep buffers current from a change stream.

The stream carries ``(buf, seq, ctick, op, first, last, lines)`` rows with ``op``
in ``lines`` (replace ``[first, last)``), ``tick`` (tick only) and ``detach``
(drop the buffer).  Ticks of an open buffer begin at 1; ``lines`` at tick 0 is
an attach: it opens the buffer anew, whatever was there.

``seq`` is the event's place in the change log (an offset, a line number): the
order of arrival, which ticks do not give, as they begin anew with every
attach.  A micro-batch applies a buffer's events in that order; events without
one come first, in tick order.  State per buffer --
its lines, tick and initialised flag -- lives in the state store, keyed and
partitioned by ``buf``.  Other edits whose tick is not newer than the stored tick go
to the output with status ``late`` and are not applied.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tagweave.operators.edits import apply_edit
from tagweave.workers import ship_by_value

ship_by_value(__name__)

EDIT_STREAM_SCHEMA = StructType(
    [
        StructField("buf", LongType()),
        StructField("ctick", LongType()),
        StructField("op", StringType()),
        StructField("first", LongType()),
        StructField("last", LongType()),
        StructField("lines", ArrayType(StringType())),
        StructField("seq", LongType()),
    ]
)

STATE_SCHEMA = StructType(
    [
        StructField("lines", ArrayType(StringType())),
        StructField("ctick", LongType()),
        StructField("initialized", BooleanType()),
    ]
)

OUTPUT_SCHEMA = StructType(
    [
        StructField("buf", LongType()),
        StructField("ctick", LongType()),
        StructField("status", StringType()),
        StructField("n_lines", LongType()),
        StructField("text", StringType()),
        StructField("initialized", BooleanType()),
    ]
)


def _in_order(batches: Iterator[pd.DataFrame]) -> list[tuple]:
    """A buffer's events of one micro-batch in the order of arrival."""
    events = []
    for pdf in batches:
        for ctick, op, first, last, repl, seq in zip(
            pdf["ctick"], pdf["op"], pdf["first"], pdf["last"], pdf["lines"], pdf["seq"]
        ):
            known, tick = pd.notna(seq), int(ctick) if pd.notna(ctick) else 0
            events.append(((known, int(seq) if known else 0, tick), op, first, last, repl))
    events.sort(key=lambda e: e[0])  # stable: what is equal stays as it came
    return [(order[2], op, first, last, repl) for order, op, first, last, repl in events]


def _replay(idle: int | None):
    def replay(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Apply one buffer's new events.

        A detach drops the buffer and an attach opens it anew; edits after a detach
        start from a fresh buffer.  So the outcome does
        not depend on where batches end.
        """
        (buf,) = key
        names = [f.name for f in OUTPUT_SCHEMA.fields]
        if state.hasTimedOut:
            _, tick, _ = state.get
            state.remove()
            yield pd.DataFrame([(buf, tick, "expired", None, None, None)], columns=names)
            return
        lines, tick, init = state.get if state.exists else ([""], None, False)
        lines, alive = list(lines), state.exists
        out = []
        for ctick, op, first, last, repl in _in_order(batches):
            repl = [] if repl is None else list(repl)
            if op == "lines" and ctick == 0:
                lines, init = apply_edit(([""], False), int(first), int(last), repl)
                tick, alive = 0, True
            elif tick is not None and ctick <= tick:
                out.append((buf, ctick, "late", None, None, None))
            elif op == "detach":
                out.append((buf, ctick, "detached", None, None, None))
                (lines, tick, init), alive = ([""], None, False), False
            else:
                if op == "lines":
                    lines, init = apply_edit((lines, init), int(first), int(last), repl)
                tick, alive = ctick, True
        if alive:
            state.update((lines, tick, init))
            if idle is not None:
                state.setTimeoutDuration(idle)
            out.append((buf, tick, "current", len(lines), "\n".join(lines), init))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    return replay


def buffer_states(edit_stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Per micro-batch, the current state of every buffer that changed, plus
    ``late`` and ``detached`` markers.  Works on batch frames as well.

    With ``idle_ms`` a buffer without events for that long leaves the state
    store, with an ``expired`` marker, so the state does not grow with buffers
    that are never closed; a later edit finds a fresh buffer.
    """
    if "seq" not in edit_stream.columns:
        edit_stream = edit_stream.withColumn("seq", F.lit(None).cast("long"))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return edit_stream.groupBy("buf").applyInPandasWithState(
        _replay(idle_ms), OUTPUT_SCHEMA, STATE_SCHEMA, "update", timeout
    )


def seen_files(events: DataFrame, file: str = "filename") -> DataFrame:
    """Files that were closed at least once (their index is rebuilt when they open again)."""
    return events.where(F.col("op") == "detach").select(file).distinct()


def attached_edits(snapshots: DataFrame, edits: DataFrame) -> DataFrame:
    """The stream of a buffer's life: attached snapshots and edits (``seq`` tells their order)."""
    columns = [f.name for f in EDIT_STREAM_SCHEMA.fields]
    if "seq" not in edits.columns:
        edits = edits.withColumn("seq", F.lit(None).cast("long"))
    return attach_events(snapshots).unionByName(edits.select(*columns))


def publish(out_path: str):
    """``foreachBatch`` sink: write each micro-batch under ``batch_id=<id>``
    with overwrite, so a replayed batch rewrites the same files (idempotent)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .parquet(f"{out_path}/batch_id={batch_id}")
        )

    return write


def read_change_stream(spark, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Change events as a stream from files (explicit schema, no inference)."""
    reader = spark.readStream.schema(EDIT_STREAM_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def attach_events(snapshots: DataFrame, text: str = "text") -> DataFrame:
    """Attach: a document snapshot opens the buffer at tick 0, at its place ``seq`` in the
    change log (without that column: first among the events of a batch)."""
    seq = F.col("seq").cast("long") if "seq" in snapshots.columns else F.lit(None).cast("long")
    return snapshots.select(
        F.col("doc_id").alias("buf"),
        F.lit(0).cast("long").alias("ctick"),
        F.lit("lines").alias("op"),
        F.lit(0).cast("long").alias("first"),
        F.lit(1).cast("long").alias("last"),
        F.split(F.col(text), "\n").alias("lines"),
        seq.alias("seq"),
    )
