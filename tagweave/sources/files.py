"""File sources and sinks: symbol index text, whole source files, manifests.

Text codecs are chosen by file suffix by Spark's text source (gzip, bzip2,
deflate, lz4, snappy).  xz has no Hadoop codec here -- ``read.text`` on an
``.xz`` file returns the compressed bytes as garbage lines -- so xz files are
read with ``binaryFile`` and decoded in an Arrow-batched ``mapInPandas``.
"""

from __future__ import annotations

import io
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import read_if_exists
from tagweave.workers import ship_by_value

ship_by_value(__name__)

INDEX_SCHEMA = "path string, line_no long, line string"
_LINE_BATCH = 65536


def _decode_xz(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            # decoded as a stream: only the compressed bytes and one batch of lines are held
            start, chunk = 0, []
            reader = io.TextIOWrapper(lzma.open(io.BytesIO(content)), "utf-8", errors="replace", newline="\n")
            for line in reader:
                chunk.append(line.removesuffix("\n"))
                if len(chunk) == _LINE_BATCH:
                    yield _numbered(path, start, chunk)
                    start, chunk = start + len(chunk), []
            if chunk:
                yield _numbered(path, start, chunk)


def _numbered(path: str, start: int, lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "line_no": range(start, start + len(lines)), "line": lines})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index lines ``(path, line)`` from plain, gzip, bzip2 or xz text files.

    ``path`` may be a file, directory or glob, with files of any of these kinds
    side by side: xz files are told by their suffix, file by file, and everything
    else goes through ``spark.read.text``.  Gzip files are not splittable, so
    large ones are read by one task each.
    """
    # a filter on the path comes after the content is read, so other files are not listed at all
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.xz").load(path).select("path", "content")
    plain = spark.read.text(path).where(~F.col("_metadata.file_path").endswith(".xz"))
    return (
        packed.mapInPandas(_decode_xz, INDEX_SCHEMA)
        .select("path", "line")
        .unionByName(plain.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")))
    )


def write_index(df: DataFrame, path: str, compression: str = "none", line: str = "line") -> None:
    """Write index lines as text (``none``, ``gzip`` or ``bzip2``); overwrite."""
    df.select(F.col(line).alias("value")).write.mode("overwrite").option(
        "compression", compression
    ).text(path)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Whole files ``(path, text)`` (``binaryFile``); bytes that are not UTF-8 become
    U+FFFD, unreadable or vanished files are skipped (:func:`skipped_sources` names them)."""
    return (
        spark.read.format("binaryFile")
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
        .load(path)
        .select(F.regexp_replace("path", "^file:", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    )


def skipped_sources(spark: SparkSession, path: str, read: DataFrame) -> DataFrame:
    """``(path, length, modificationTime)`` of files listed under ``path`` that ``read``, rows
    of :func:`read_sources` of the same path, does not hold; contents are not opened."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    listed = listed.withColumn("path", F.regexp_replace("path", "^file:", ""))
    return listed.join(read.select("path").distinct(), "path", "left_anti")


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(path, dir, file, length, modificationTime)`` of every file under
    ``root``; the content column is pruned, so files are only listed."""
    m = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length", "modificationTime")
    )
    clean = F.regexp_replace("path", "^file:", "")
    return m.select(
        clean.alias("path"),
        F.regexp_extract(clean, r"^(.*)/[^/]*$", 1).alias("dir"),
        F.regexp_extract(clean, r"([^/]*)$", 1).alias("file"),
        "length",
        "modificationTime",
    )


def read_root_list(spark: SparkSession, path: str) -> DataFrame:
    """One project-root prefix per line; a missing file means no list (empty).
    Blank lines are dropped (a blank prefix would match every path)."""
    lines = read_if_exists(spark, path, "text")
    if lines is None:
        df = spark.range(0).select(F.lit(None).cast("string").alias("root"))
    else:
        df = lines.select(F.col("value").alias("root"))
    return df.where(F.length("root") > 0)
