"""Replay line edits into buffer contents.

An edit ``(buf, ctick, first, last, lines)`` replaces lines ``[first, last)``
of the buffer with ``lines``.  A buffer starts as one empty line and never
drops below one; a single empty line sent into an (almost) empty buffer at
line 0 is a no-op; the first other edit marks the buffer initialised.

Edits of one buffer are composed, not only applied: a run of edits is a list of
pieces, ranges of the lines it was given and lines of its own, and two lists in
a row are one list.  So a buffer's history can be cut anywhere:

1. All edits are sorted by range over (buffer, tick, sequence); a hot buffer
   covers many partitions.  A partition's edits of one buffer are a run.
2. What a run does depends on how many lines it meets, as positions behind the
   end mean the end.  Each run that does not start its buffer gives its number
   of lines as a function of that (straight pieces of slope 0 and 1,
   :class:`LineCount`); only these travel to one place per buffer.
3. Knowing its lines, every run is composed to its pieces in parallel, and the
   runs of a buffer are merged ``FAN`` at a time, in rounds.

Memory holds a run's edits one batch at a time and one buffer's lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import cut_lineage
from tagweave.workers import ship_by_value

ship_by_value(__name__)

STATE_SCHEMA = "buf long, ctick long, n_lines long, text string, initialized boolean"


def is_noop(lines: list[str], first: int, repl: list[str]) -> bool:
    """One empty string inserted at line 0 of a buffer with at most one line."""
    return len(lines) <= 1 and first == 0 and len(repl) == 1 and repl[0] == ""


def splice(lines: list[str], first: int, last: int, repl: list[str]) -> list[str]:
    """Lines ``[first, last)`` replaced by ``repl``; indices past the end clamp
    (so ``first >= len`` appends).  The result is never empty."""
    out = lines[:first] + list(repl) + lines[max(last, first):]
    return out or [""]


def apply_edit(state: tuple[list[str], bool], first: int, last: int, repl: list[str]):
    lines, initialized = state
    if is_noop(lines, first, repl):
        return lines, initialized
    return splice(lines, first, last, repl), True


class LineCount:
    """Lines after a run of edits as a function of the lines before it (one or more).

    ``value`` at each ``start``, growing with ``slope`` (0 or 1) up to the next;
    it never falls, so an edit meets each of its borders in one piece at most.
    """

    def __init__(self, start=(1,), value=(1,), slope=(1,)):
        self.start, self.value, self.slope = (np.array(x, np.int64) for x in (start, value, slope))

    def _split(self, border: int) -> None:
        """Let no piece hold both ``border`` and ``border + 1`` lines."""
        i = int(np.searchsorted(self.value, border, "right")) - 1
        if i < 0 or not self.slope[i]:
            return
        at = self.start[i] + border - self.value[i] + 1
        if i + 1 < len(self.start) and at >= self.start[i + 1]:
            return
        self.start = np.insert(self.start, i + 1, at)
        self.value = np.insert(self.value, i + 1, border + 1)
        self.slope = np.insert(self.slope, i + 1, 1)

    def edit(self, first: int, last: int, repl: list[str]) -> None:
        last, blank = max(first, last), first == 0 and len(repl) == 1 and repl[0] == ""
        for border in {first, last, 1} if blank else {first, last}:
            self._split(border)
        v, n = self.value, len(repl)
        inside = (v > first) & (v <= last)
        after = np.where(v <= first, v + n, np.where(inside, first + n, v - (last - first) + n))
        kept = blank & (v <= 1)
        self.value = np.where(kept, v, np.maximum(after, 1))
        self.slope = np.where(inside & ~kept, 0, self.slope)
        same = (self.slope[1:] == self.slope[:-1]) & (
            self.value[1:] == self.value[:-1] + self.slope[:-1] * np.diff(self.start)
        )
        if same.any():
            keep = np.concatenate(([True], ~same))
            self.start, self.value, self.slope = self.start[keep], self.value[keep], self.slope[keep]

    def __call__(self, lines: int) -> int:
        i = int(np.searchsorted(self.start, lines, "right")) - 1
        return int(self.value[i] + self.slope[i] * (lines - self.start[i]))


def to_pieces(lines: list) -> list[dict]:
    """Lines given as numbers (of lines met) and strings (own ones), as pieces."""
    pieces: list[dict] = []
    for line in lines:
        top = pieces[-1] if pieces else None
        if isinstance(line, str):
            if top is None or top["own"] is None:
                pieces.append({"first": None, "last": None, "own": []})
            pieces[-1]["own"].append(line)
        elif top is not None and top["own"] is None and top["last"] == line:
            top["last"] += 1
        else:
            pieces.append({"first": line, "last": line + 1, "own": None})
    return pieces


def apply_pieces(lines: list, pieces) -> list:
    """The lines that ``pieces`` make of ``lines``."""
    out: list = []
    for piece in pieces:
        own = piece["own"]
        out += lines[int(piece["first"]) : int(piece["last"])] if own is None else list(own)
    return out


#: Runs of one buffer that a task merges in one round.
FAN = 8

_RUN = "buf long, part int, ctick long, start array<long>, value array<long>, slope array<long>"
_PIECES = "array<struct<first: long, last: long, own: array<string>>>"
_MERGED = f"buf long, rank long, runs long, ctick long, initialized boolean, pieces {_PIECES}"


def _edits_of(batches: Iterator[pd.DataFrame]):
    """``(row, first, last, lines)`` of sorted edits."""
    for pdf in batches:
        for row, first, last, repl in zip(pdf.itertuples(index=False), pdf["first"], pdf["last"], pdf["lines"]):
            yield row, int(first), int(last), [] if repl is None else list(repl)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per buffer of a sorted partition: its last tick and its line count function."""
    part, cur, count, tick, out = TaskContext.get().partitionId(), None, None, None, []

    def row():
        return (cur, part, tick, count.start, count.value, count.slope)

    names = [f.split()[0] for f in _RUN.split(", ")]
    for edit, first, last, repl in _edits_of(batches):
        if count is None or edit.buf != cur:
            if count is not None:
                out.append(row())
            if len(out) >= 1024:
                yield pd.DataFrame(out, columns=names)
                out = []
            cur, count = edit.buf, LineCount()
        count.edit(first, last, repl)
        tick = edit.ctick
    if count is not None:
        out.append(row())
    if out:
        yield pd.DataFrame(out, columns=names)


def _meets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs sorted by (buf, part): how many lines each meets, and its rank in its buffer."""
    cur, lines, rank = None, 1, 0
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.buf != cur:
                cur, lines, rank = r.buf, 1, 0
            out.append((r.buf, r.part, lines, rank))
            lines, rank = LineCount(r.start, r.value, r.slope)(lines), rank + 1
        yield pd.DataFrame(out, columns=["buf", "part", "lines_met", "rank"])


def _compose_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of a sorted partition with their run's rank and lines: one row of pieces a run."""
    cur, lines, out = None, [], []
    names = ["buf", "rank", "runs", "ctick", "initialized", "pieces"]

    def row():
        return (cur.buf, cur.rank, cur.runs, tick, init, to_pieces(lines))

    for edit, first, last, repl in _edits_of(batches):
        if cur is None or (edit.buf, edit.rank) != (cur.buf, cur.rank):
            if cur is not None:
                out.append(row())
            if len(out) >= 256:
                yield pd.DataFrame(out, columns=names)
                out = []
            cur, lines, init = edit, list(range(int(edit.lines_met))), False
        lines, init = apply_edit((lines, init), first, last, repl)
        tick = edit.ctick
    if cur is not None:
        out.append(row())
    if out:
        yield pd.DataFrame(out, columns=names)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (buf, rank): each ``FAN`` ranks of a buffer become one."""
    cur, names = None, ["buf", "rank", "runs", "ctick", "initialized", "pieces"]
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if cur is not None and (r.buf, r.rank // FAN) == (cur[0], cur[1]):
                lines, tick, init = apply_pieces(lines, r.pieces), r.ctick, init or r.initialized
            else:
                if cur is not None:
                    out.append((*cur, tick, init, to_pieces(lines)))
                cur = (r.buf, r.rank // FAN, -(-r.runs // FAN))
                lines, tick, init = apply_pieces(_numbers(r.pieces), r.pieces), r.ctick, r.initialized
        if out:
            yield pd.DataFrame(out, columns=names)
    if cur is not None:
        yield pd.DataFrame([(*cur, tick, init, to_pieces(lines))], columns=names)


def _numbers(pieces) -> range:
    """Numbers of all the lines that ``pieces`` may take."""
    return range(max((int(p["last"]) for p in pieces if p["own"] is None), default=0))


def _final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            lines = apply_pieces([""], r.pieces)
            out.append((r.buf, r.ctick, len(lines), "\n".join(lines), r.initialized))
        yield pd.DataFrame(out, columns=["buf", "ctick", "n_lines", "text", "initialized"])


def replay_edits(edits: DataFrame, partitions: int | None = None, seq: str | None = None) -> DataFrame:
    """Final state per buffer: ``(buf, ctick, n_lines, text, initialized)``.

    Edits with equal ticks are taken in the order of column ``seq`` if one is given.
    """
    order = ["buf", "ctick", *([seq] if seq else [])]
    e = edits.select(*order, "first", "last", "lines").where(F.col("buf").isNotNull())
    ranged = e.repartitionByRange(partitions, *order) if partitions else e.repartitionByRange(*order)
    # The cut into partitions is made once: both passes over the edits read this table.
    ranged = cut_lineage(ranged.sortWithinPartitions(*order))
    runs = ranged.mapInPandas(_runs, _RUN)
    met = runs.repartition("buf").sortWithinPartitions("buf", "part").mapInPandas(
        _meets, "buf long, part int, lines_met long, rank long"
    )
    met = cut_lineage(met)
    count = met.groupBy("buf").agg(F.count(F.lit(1)).alias("runs"))
    most = count.agg(F.max("runs")).first()[0] or 0
    known = met.join(count, "buf").withColumnsRenamed({"buf": "_buf", "part": "_part"})
    rows = (
        ranged.withColumn("part", F.spark_partition_id())
        .join(known, (F.col("buf") == F.col("_buf")) & (F.col("part") == F.col("_part")))
        .repartition("buf", "part").sortWithinPartitions("buf", "part", *order[1:])
        .select(*order, "first", "last", "lines", "lines_met", "rank", "runs")
    )
    merged = rows.mapInPandas(_compose_runs, _MERGED)
    while most > 1:
        merged = cut_lineage(
            merged.withColumn("_group", F.expr(f"rank div {FAN}"))
            .repartition("buf", "_group").sortWithinPartitions("buf", "rank").drop("_group")
            .mapInPandas(_merge, _MERGED)
        )
        most = -(-most // FAN)
    return merged.mapInPandas(_final, STATE_SCHEMA)


def late_edits(edits: DataFrame, stored: DataFrame) -> DataFrame:
    """Edits whose tick is not newer than the buffer's stored tick."""
    return edits.join(stored.select("buf", F.col("ctick").alias("_stored")), "buf").where(
        F.col("ctick") <= F.col("_stored")
    ).drop("_stored")
