"""Matches kept current when documents and index both change.

A store holds what the last run matched: the documents with their ticks, the
index, the matches, and postings (name -> documents) in hash buckets.  Against
it a new snapshot needs three small joins instead of a full one:

* documents whose tick, language or source moved, and new ones, are tokenized
  and joined with the whole new index;
* names of index rows that came or went ("touched") are looked up in the
  postings of the documents that stayed, in the buckets that hold them;
* all other stored matches of documents that stayed are kept as they are.

So a document that did not change is never tokenized again, whatever the index
does, and an index row that did not change is joined with changed documents only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.match import document_tokens, is_small, match_tags
from tagweave.session import cut_lineage

BUCKETS = 64
#: Tasks that write one bucket, so that a name of every document is not one task's.
WRITERS = 8
#: Sorted postings take a byte or two each, so files are cut by rows: a scan task has a few.
FILE_ROWS = 500_000
_NAME = ["lang", "name"]
_MATCH = ["lang", "name", "kind"]


def _bucket():
    return F.pmod(F.xxhash64(*_NAME), F.lit(BUCKETS)).cast("int")


def _index(norm_tags: DataFrame) -> DataFrame:
    return norm_tags.select(F.col("target_lang").alias("lang"), "name", "file", "kind").distinct()


def _write_postings(postings: DataFrame, path: str) -> None:
    share = F.pmod(F.xxhash64("doc_id"), F.lit(WRITERS))
    (
        postings.withColumn("bucket", _bucket())
        .repartition(BUCKETS * WRITERS, "bucket", share)
        .sortWithinPartitions("bucket", *_NAME)
        .write.partitionBy("bucket")
        .option("maxRecordsPerFile", FILE_ROWS)
        .parquet(path)
    )


def _read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings with the bucket; the schema is named, as an empty table has no files to tell it."""
    kind = spark.read.parquet(f"{path}/docs").schema["doc_id"].dataType.simpleString()
    return spark.read.schema(f"doc_id {kind}, lang string, name string, bucket int").parquet(f"{path}/postings")


def store_matches(docs: DataFrame, norm_tags: DataFrame, path: str, tick: str = "n_chars") -> None:
    """Write the store for ``docs (doc_id, lang, source, text, <tick>)`` at ``path``, a
    folder that does not exist yet.  ``doc_id`` is a key; rows without one have no
    state and are matched anew every time."""
    docs = docs.where(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    docs.select("doc_id", "lang", "source", F.col(tick).alias("tick")).write.parquet(f"{path}/docs")
    _index(norm_tags).write.parquet(f"{path}/index")
    _write_postings(document_tokens(docs).select("doc_id", *_NAME), f"{path}/postings")
    seen, index = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/index")
    _lookup(_read_postings(spark, path), seen, index).write.parquet(f"{path}/matches")


def _lookup(postings: DataFrame, docs: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, lang, name, kind)``: names in the postings, tags of the own file."""
    out, small = ["doc_id", *_MATCH], is_small(index)
    names = index.select(*_MATCH).distinct()
    by_name = postings.join(F.broadcast(names) if small else names, _NAME).select(*out)
    files = docs.select("doc_id", "lang", F.col("source").alias("file"))
    by_file = files.join(F.broadcast(index) if small else index, ["lang", "file"]).select(*out)
    # no partial step: a scan task's postings are one row of a match each, hardly any repeats
    return by_name.unionByName(by_file).repartition("doc_id").distinct()


def touched_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct ``(lang, name, kind)`` of the index rows that are in one of the two only."""
    sides = before.withColumn("_side", F.lit(1)).unionByName(after.withColumn("_side", F.lit(2)))
    return (
        sides.groupBy("lang", "name", "file", "kind").agg(F.bit_or("_side").alias("_sides"))
        .where(F.col("_sides") != 3).select(*_MATCH).distinct()
    )


def split_documents(stored: DataFrame, docs: DataFrame, tick: str = "n_chars") -> tuple[DataFrame, DataFrame]:
    """``(stayed, moved)``: ids of stored documents that are the same in ``docs``, and the
    rows of ``docs`` that are new or changed.  Texts are not looked at."""
    same = docs.select("doc_id", "lang", "source", F.col(tick).alias("tick"))
    was = stored.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("lang", "source", "tick")])
    stayed = same.join(was, "doc_id")
    for c in ("lang", "source", "tick"):
        stayed = stayed.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    stayed = stayed.select("doc_id")
    return stayed, docs.join(stayed, "doc_id", "left_anti")


def delta_matches(
    spark: SparkSession, path: str, docs: DataFrame, norm_tags: DataFrame, tick: str = "n_chars"
) -> DataFrame:
    """Distinct ``(doc_id, name, kind)`` of ``docs`` against ``norm_tags``, equal to
    ``match_tags(docs, norm_tags)``, from the store at ``path``."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    index, stored_docs = _index(norm_tags), read("docs")
    stayed, moved = split_documents(stored_docs, docs, tick)
    touched = cut_lineage(touched_names(read("index"), index))
    buckets = [r[0] for r in touched.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS

    out = ["doc_id", "name", "kind"]
    matches = read("matches").join(stayed, "doc_id", "left_semi")
    kept = matches.join(touched, _MATCH, "left_anti").select(*out)

    live = index.join(touched, _MATCH, "left_semi")  # touched names as they are now
    postings = _read_postings(spark, path).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    names = _lookup(postings.drop("bucket"), stored_docs, live)
    renewed = names.join(stayed, "doc_id", "left_semi").select(*out)

    fresh = match_tags(moved.select("doc_id", "lang", "source", "text"), norm_tags)
    return kept.unionByName(renewed).unionByName(fresh)
