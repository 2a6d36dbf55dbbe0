"""Comments, literals and ``#if 0`` regions of code decided together.

A directive counts only where its line starts as code: not inside a comment or
a literal.  Inside a region nothing but directives counts.  So neither can be
taken out before the other; one lexer reads a text from left to right in one of
five modes.

* ``#if 0`` at the start of a line (C and C++) removes all lines up to its
  ``#endif`` (``#if*`` lines inside are counted, ``#else`` is not special), or
  up to the end of the text;
* a comment or a literal becomes one blank; one that is never closed is code.

:func:`strip_joint` lexes whole texts, row by row, without a key or a shuffle.
:func:`strip_blocks` takes texts that are stored as blocks of lines and lexes
the blocks in parallel: a block's transition table says in which mode it ends
for each mode in which it may begin; composed in block order the tables give
the mode at each block's start, and a second pass lexes each block from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.constants import C_FAMILY, C_LIKE_LANGS, ENDIF_DIRECTIVE, IF0_DIRECTIVE, IF_DIRECTIVE
from tagweave.functions.text import strip_source
from tagweave.workers import ship_by_value

#: Modes: code, inside a comment, inside a string, inside a character literal, inside a region.
CODE, COMMENT, STRING, CHAR, REGION = range(5)

_HASH = r"^[ \t]*#[ \t]*"
_STOP = r"/\*|//[^\n]*+|[\"']"
_code_stop = re.compile(_STOP).search
_c_stop = re.compile(rf"(?m){_HASH}{IF0_DIRECTIVE}[^\n]*+\n?|{_STOP}").search
_directives = re.compile(rf"(?m){_HASH}({IF_DIRECTIVE}|{ENDIF_DIRECTIVE})[^\n]*+\n?").finditer
#: What is left of a literal, from behind its quote or from the start of a line.
_rest = {
    STRING: re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S).match,
    CHAR: re.compile(r"[^'\\]*+(?:\\.[^'\\]*+)*+'", re.S).match,
}
#: The same as Spark expressions, for :func:`strip_blocks`.
_CLOSES = [r"\*/", r'^[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"', r"^[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"]


def _close(text: str, mode: int, at: int) -> int:
    """Behind the end of the comment or literal that is open at ``at``; -1 if it stays open."""
    if mode == COMMENT:
        end = text.find("*/", at)
        return end + 2 if end >= 0 else -1
    found = _rest[mode](text, at)
    return found.end() if found else -1


def _leave_region(text: str, at: int, depth: int) -> tuple[int, int]:
    """Behind the line that ends the region that is ``depth`` deep at ``at``, and depth 0;
    or the end of the text and the depth there."""
    for line in _directives(text, at):
        depth += 1 if line.group(1) == IF_DIRECTIVE else -1
        if depth == 0:
            return line.end(), 0
    return len(text), depth


def lex(
    text: str, directives: bool, mode: int = CODE, depth: int = 0, later: tuple[bool, bool, bool] = (False,) * 3
) -> tuple[str, int, int]:
    """The stripped text, and the mode and depth in which it ends.

    ``later``: whether a comment, string or character literal that is open at
    the end is closed in what follows.
    """
    out, at, size = [], 0, len(text)
    stop = _c_stop if directives else _code_stop
    if mode == REGION:
        at, depth = _leave_region(text, 0, depth)
        if depth:
            return "", REGION, depth
    elif mode != CODE:
        at = _close(text, mode, 0)
        if at < 0:
            return "", mode, 0
    while at < size:
        found = stop(text, at)
        if not found:
            break
        out.append(text[at : found.start()])
        token, at = found.group(), found.end()
        if token[:2] == "//":
            out.append(" ")
        elif token in ('"', "'", "/*"):
            kind = {"/*": COMMENT, '"': STRING, "'": CHAR}[token]
            end = _close(text, kind, at)
            if end >= 0:
                out.append(" ")
                at = end
            elif later[kind - 1]:
                out.append(" ")
                return "".join(out), kind, 0
            else:
                out.append(token)
        else:
            at, depth = _leave_region(text, at, 1)
            if depth:
                return "".join(out), REGION, depth
    out.append(text[at:])
    return "".join(out), CODE, 0


def transitions(text: str, directives: bool, later: tuple[bool, bool, bool]) -> tuple[list[int], list[int], int]:
    """Modes and depths in which a block ends: for beginning as code, comment, string and
    character literal, then for beginning in a region 1, 2, ... deep, as far as the block
    can end such a region; and by how much it changes deeper ones."""
    ends = [lex(text, directives, mode, 0, later)[1:] for mode in (CODE, COMMENT, STRING, CHAR)]
    depth, lowest = 0, 0
    for line in _directives(text) if directives else ():
        depth += 1 if line.group(1) == IF_DIRECTIVE else -1
        if depth < lowest:
            lowest = depth
            ends.append(lex(text[line.end() :], directives, CODE, 0, later)[1:])
    return [m for m, _ in ends], [d for _, d in ends], depth


def strip_joint(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``text`` stripped.  Texts of C-like languages without a ``#if 0`` line
    are one native expression; only the others of C and C++ go through :func:`lex`."""
    has = F.coalesce(
        F.col(lang).isin(*C_FAMILY) & F.col(text).rlike(rf"(?m){_HASH}{IF0_DIRECTIVE}"), F.lit(False)
    )
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([lex(t, True)[0] for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = docs.where(~has).withColumn(text, strip_source(text, lang))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    return plain.unionByName(docs.where(has).mapInArrow(run, schema))


def line_blocks(docs: DataFrame, size: int = 1 << 20, key: str = "doc_id") -> DataFrame:
    """``(key, lang, block, text)``: texts cut behind a line end, ``size`` or more code points each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, blocks = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                at, block = 0, 0
                while text is not None:
                    end = text.find("\n", at + size - 1) + 1 if len(text) - at > size else 0
                    rows.append(row)
                    blocks.append(block)
                    texts.append(text[at : end or None])
                    at, block = end, block + 1
                    if not end:
                        break
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(blocks, pa.int32()), pa.array(texts, pa.string())],
                names=["key", "lang", "block", "text"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col("lang").cast("string").alias("lang"), F.col("text"))
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, lang string, block int, text string")


def strip_blocks(blocks: DataFrame) -> DataFrame:
    """``(key, lang, block, text)`` with each text stripped as part of its document.

    Keys are unique to a document.  Only the tables travel by key: a few
    numbers a block; the texts are read twice and joined by (key, block).
    """
    directives = F.coalesce(F.col("lang").isin(*C_FAMILY), F.lit(False))
    by_key = Window.partitionBy("key").orderBy("block")
    after = by_key.rowsBetween(1, Window.unboundedFollowing)
    closes = [F.col("text").rlike(p) for p in _CLOSES]
    # Which open tokens are closed later: the last block that closes each, no text in the shuffle.
    marks = blocks.where(F.coalesce(F.col("lang").isin(*C_LIKE_LANGS), F.lit(False))).select(
        "key", "block", *[c.alias(f"c{i}") for i, c in enumerate(closes)]
    )
    later = marks.select(
        "key",
        "block",
        F.array(*[F.coalesce(F.max(f"c{i}").over(after), F.lit(False)) for i in range(3)]).alias("later"),
    )
    known = blocks.join(later, ["key", "block"]).select("key", "block", directives.alias("directives"), "later", "text")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, later, text = (batch.column(i).to_pylist() for i in (2, 3, 4))
            found = [transitions(t, d, tuple(x)) for t, d, x in zip(text, flags, later)]
            modes, depths, changes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(modes, pa.list_(pa.int32())), pa.array(depths, pa.list_(pa.int32())),
                 pa.array(changes, pa.int32())],
                names=["key", "block", "directives", "later", "modes", "depths", "change"],
            )

    kind = dict(blocks.dtypes)["key"]
    head = f"key {kind}, block int, directives boolean, later array<boolean>"
    tabled = known.mapInArrow(tables, f"{head}, modes array<int>, depths array<int>, change int")
    # Composition in block order: the state behind each block, by one fold per document.
    states = tabled.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("block", "modes", "depths", "change", "directives", "later"))).alias("b")
    )
    place = f"case when s[size(s) - 1].mode < {REGION} then s[size(s) - 1].mode else {REGION - 1} + s[size(s) - 1].depth end"
    fold = (
        "aggregate(b, array(named_struct('mode', 0, 'depth', 0)), (s, x) -> concat(s, array(named_struct("
        f"'mode', coalesce(get(x.modes, {place}), {REGION}),"
        f"'depth', coalesce(get(x.depths, {place}), s[size(s) - 1].depth + x.change)))))"
    )
    starts = states.select("key", F.expr(f"arrays_zip(b, slice({fold}, 1, size(b)))").alias("z")).select(
        "key", F.explode("z").alias("z")
    )
    starts = starts.select(
        "key", F.col("z.b.block").alias("block"), F.col("z.b.directives").alias("directives"),
        F.col("z.b.later").alias("later"), F.col("z.1.mode").alias("mode"), F.col("z.1.depth").alias("depth"),
    )
    lexed = blocks.join(starts, ["key", "block"], "left").select(
        "key", "lang", "block", "text", "directives", "later", "mode", "depth"
    )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, flags, later, mode, depth = (batch.column(i).to_pylist() for i in range(3, 8))
            out = [
                t if d is None else lex(t, d, m, n, tuple(x))[0] for t, d, x, m, n in zip(text, flags, later, mode, depth)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out, pa.string())], names=["key", "lang", "block", "text"]
            )

    return lexed.mapInArrow(strip, f"key {kind}, lang string, block int, text string")


def joined_blocks(blocks: DataFrame) -> DataFrame:
    """``(key, lang, text)``: the blocks of each document put together."""
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    return blocks.groupBy("key", "lang").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


ship_by_value(__name__)
