"""Drop ``#if 0`` regions from C code.

A region starts at a ``#if 0`` line and ends at its matching ``#endif``
(nested ``#if*`` lines are counted, ``#else`` is not special); without a
matching ``#endif`` it runs to the end of the document.

Plan: one hash exchange on ``doc_id`` and three sorted window passes inside
it, no join.  With ``S`` the running sum of +1 per ``#if*`` and -1 per
``#endif``, the matching ``#endif`` of an ``#if`` whose sum before it is ``L``
is the first later ``#endif`` whose sum after it is ``L`` -- the first
``#endif`` in the window partition ``(doc_id, L)`` after the ``#if``.  A line
is inside a region when the running maximum of region ends up to it reaches
it.  Regions nested in a region are inside it, so their union is exact.
A document is one input row, so a per-document window is bounded by the
largest row, not by a key's share of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.constants import C_FAMILY, ENDIF_DIRECTIVE, IF0_DIRECTIVE, IF_DIRECTIVE

_HASH = r"^[ \t]*#"
_REST = r"^[ \t]*#[ \t]*"


def mark_if0(lines: DataFrame, lang: str = "lang") -> DataFrame:
    """Add ``in_if0`` (boolean) to ``(doc_id, line_no, line, lang)`` rows."""
    is_hash = F.col("line").rlike(_HASH)
    rest = F.regexp_replace(F.col("line"), _REST, "")
    is_c = F.col(lang).isin(*C_FAMILY)
    op_if = is_hash & F.startswith(rest, F.lit(IF_DIRECTIVE))
    op_endif = is_hash & F.startswith(rest, F.lit(ENDIF_DIRECTIVE))
    is_if0 = is_c & is_hash & F.startswith(rest, F.lit(IF0_DIRECTIVE))

    by_doc = Window.partitionBy("doc_id").orderBy("line_no")
    running = by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = lines.select(
        "*",
        F.when(op_if, 1).when(op_endif, -1).otherwise(0).alias("_delta"),
        op_if.alias("_if"),
        op_endif.alias("_endif"),
        is_if0.alias("_if0"),
    )
    x = x.withColumn("_level", F.sum("_delta").over(running) - F.col("_if").cast("int"))
    # First #endif after this row at the same level: a running min over the
    # reversed order (an incremental frame, linear in the partition size).
    later = (
        Window.partitionBy("doc_id", "_level")
        .orderBy(F.col("line_no").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    x = x.withColumn(
        "_end",
        F.when(
            F.col("_if0"),
            F.coalesce(
                F.min(F.when(F.col("_endif"), F.col("line_no"))).over(later),
                F.lit(2**63 - 1),
            ),
        ),
    )
    x = x.withColumn("_cover", F.max("_end").over(running))
    in_if0 = F.coalesce(F.col("_cover") >= F.col("line_no"), F.lit(False))
    return x.select(*lines.columns, in_if0.alias("in_if0"))


def drop_if0(lines: DataFrame, lang: str = "lang") -> DataFrame:
    """Lines outside ``#if 0`` regions (C and C++ only; others pass through)."""
    return mark_if0(lines, lang).where(~F.col("in_if0")).drop("in_if0")
