"""Line-level views of documents: dumps, ranges, size reconciliation, includes.

All row-local: a document is one row, its lines are an array, so none of
these shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.constants import INCLUDE_DIRECTIVE
from tagweave.functions.text import numbered_line

INCLUDE_REGEX = r'^#[ \t]*' + INCLUDE_DIRECTIVE + r'[ \t]*(?:"([^"]*)"|<([^>]*)>)'


def split_lines(text: str = "text"):
    return F.split(F.col(text), "\n")


def line_dump(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, line_no, entry)`` with ``entry = "N:<tab>line"`` (0-based)."""
    return docs.select("doc_id", F.posexplode(split_lines(text)).alias("line_no", "line")).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), numbered_line("line_no", "line").alias("entry")
    )


def lines_range(docs: DataFrame, start: int = 2, end: int = 5, nth: int = 3, text: str = "text") -> DataFrame:
    """Per document: line count, last line, ``nth`` line (0-based, null when
    absent) and lines ``[start, end)`` joined by newlines."""
    arr = split_lines(text)
    return docs.select(
        "doc_id",
        F.size(arr).cast("bigint").alias("n_lines"),
        F.element_at(arr, -1).alias("last_line"),
        F.try_element_at(arr, F.lit(nth + 1)).alias("nth_line"),
        F.array_join(F.slice(arr, start + 1, end - start), "\n").alias("range_text"),
    )


def reconcile(docs: DataFrame, recorded: str = "n_chars", text: str = "text") -> DataFrame:
    """Recorded size against counted size (characters, bytes, lines)."""
    return docs.select(
        "doc_id",
        F.col(recorded).cast("bigint").alias("recorded"),
        F.length(text).cast("bigint").alias("counted_chars"),
        F.octet_length(text).cast("bigint").alias("counted_bytes"),
        F.size(split_lines(text)).cast("bigint").alias("counted_lines"),
        (F.col(recorded) == F.length(text)).alias("ok"),
    )


def extract_includes(lines: DataFrame, line: str = "line") -> DataFrame:
    """Include targets of ``#include "x"`` / ``#include <x>`` lines ('#' in
    column 0); empty names yield nothing."""
    g1 = F.regexp_extract(F.col(line), INCLUDE_REGEX, 1)
    g2 = F.regexp_extract(F.col(line), INCLUDE_REGEX, 2)
    inc = F.coalesce(F.nullif(g1, F.lit("")), F.nullif(g2, F.lit("")))
    keep = [c for c in lines.columns if c != line]
    return lines.select(*keep, inc.alias("inc")).where(F.col("inc").isNotNull())
