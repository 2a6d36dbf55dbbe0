"""Buffers, project roots and project units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import literal_table

from tagweave.constants import FILETYPES
from tagweave.functions.paths import cache_key


def filetypes(spark: SparkSession) -> DataFrame:
    """The fixed 16-row filetype dimension (broadcast: size fixed by definition)."""
    return F.broadcast(literal_table(spark, FILETYPES, "ft_id int, ft string, index_name string"))


def admit_buffers(
    docs: DataFrame, fts: DataFrame, ignored_fts: list[str], rejected: DataFrame, ft: str = "ft"
) -> DataFrame:
    """Status per document, in the original order of checks: previously
    rejected id, unknown filetype, ignored filetype, else admitted.

    ``rejected``: ``(doc_id)`` of buffers rejected before.
    """
    rej = rejected.select("doc_id").distinct().withColumn("_rej", F.lit(True))
    x = docs.join(fts.select("ft_id", F.col("ft").alias(ft)), ft, "left").join(rej, "doc_id", "left")
    status = (
        F.when(F.col("_rej"), "rejected_id")
        .when(F.col("ft_id").isNull(), "unknown_filetype")
        .when(F.col(ft).isin(*ignored_fts), "ignored_filetype")
        .otherwise("admitted")
    )
    return x.select(*docs.columns, F.col("ft_id").cast("bigint").alias("ft_id"), status.alias("status"))


def longest_prefix(df: DataFrame, path: str, roots: DataFrame, root: str = "root") -> DataFrame:
    """Add ``root``: the longest string in ``roots`` that is a prefix of
    ``path`` (blank roots ignored), else ``path`` itself.

    A root can only match the prefix of a path with the root's length, so each
    distinct path is exploded into its prefixes at the lengths that roots have
    (a scalar subquery: at most as many values as the longest root has
    characters) and equi-joined with the roots: a hash join instead of a
    nested-loop ``startswith`` join, and one plan for all sizes.  The pick is
    an aggregate with a map-side partial step; it is joined back to the rows,
    so repeated rows stay.
    """
    r = roots.select(F.col(root).alias("_r")).where(F.length("_r") > 0).distinct()
    lengths = r.agg(F.collect_set(F.length("_r"))).scalar()
    paths = df.select(F.col(path).alias("_p")).where(F.col("_p").isNotNull()).distinct()
    paths = paths.withColumn("_lengths", lengths)
    fitting = F.filter("_lengths", lambda n: n <= F.length("_p"))
    prefixes = F.transform(fitting, lambda n: F.substr(F.col("_p"), F.lit(1), n))
    best = (
        paths.select("_p", F.explode(prefixes).alias("_r"))
        .join(r, "_r")
        .groupBy("_p")
        .agg(F.max_by("_r", F.length("_r")).alias("_best"))
    )
    joined = df.join(best, df[path] == best["_p"], "left")
    return joined.select(*df.columns, F.coalesce("_best", F.col(path)).alias(root))


def project_units(
    docs: DataFrame,
    roots: DataFrame,
    norecurse: DataFrame,
    filename: str = "filename",
    dirname: str = "dir",
    ft: str = "ft",
) -> DataFrame:
    """Project unit per document.

    root: longest configured prefix of the directory (else the directory);
    recurse: root not in the no-recurse list; is_c: C or C++ buffer; unit: the
    file itself for C or non-recursive projects, else the root.
    """
    x = longest_prefix(docs, dirname, roots)
    nr = norecurse.select(F.col("root").alias("_nr")).distinct().withColumn("_no", F.lit(True))
    x = x.join(nr, x["root"] == nr["_nr"], "left")
    recurse = F.col("_no").isNull()
    is_c = F.col(ft).isin("c", "cpp")
    unit = F.when(~recurse | is_c, F.col(filename)).otherwise(F.col("root"))
    return x.select(*docs.columns, "root", recurse.alias("recurse"), is_c.alias("is_c"), unit.alias("unit"))


def project_refs(units: DataFrame, ft: str = "ft") -> DataFrame:
    """Open-buffer count per (filetype, unit)."""
    return units.groupBy(ft, "unit").agg(F.count(F.lit(1)).alias("refs"))


def stream_refs(events: DataFrame, ft: str = "ft") -> DataFrame:
    """Reference counts from open (+1) / close (-1) events; units at zero are dropped."""
    delta = F.when(F.col("op") == "open", 1).when(F.col("op") == "close", -1).otherwise(0)
    return (
        events.groupBy(ft, "unit")
        .agg(F.sum(delta).cast("bigint").alias("refs"))
        .where(F.col("refs") > 0)
    )


def find_file(manifest: DataFrame, path: str = "path") -> DataFrame:
    """``(name, path)``: per base name, the shallowest path holding it (ties by
    path).  Aggregated map-side first, so the later lookup joins one row per
    name."""
    base = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    depth = F.length(path) - F.length(F.replace(F.col(path), F.lit("/"), F.lit("")))
    return manifest.groupBy(base.alias("name")).agg(
        F.min_by(path, F.struct(depth.alias("d"), F.col(path).alias("p"))).alias(path)
    )


def scan_set(units: DataFrame, headers: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(ft, unit, member)``: files the indexer reads for each unit.

    A recursive unit that is not C reads every file of ``manifest (path, ft)``
    under its root with the unit's filetype, open or not; C units read the file
    and its resolved headers; other units read the file only.

    Files meet roots by equality: each file is exploded into its parent
    directories (as many as it has levels), never by a prefix comparison of
    all files with all roots.
    """
    single = units.where(~F.col("recurse") | F.col("is_c"))
    files = single.select("ft", "unit", F.col("filename").alias("member"))
    c_units = units.where(F.col("is_c")).select("doc_id", "ft", "unit")
    hdrs = c_units.join(headers, "doc_id").select("ft", "unit", F.col("path").alias("member"))
    roots = units.where(F.col("recurse") & ~F.col("is_c")).select("ft", "unit").distinct()
    parts = F.split("path", "/")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    under = manifest.select("ft", F.col("path").alias("member"), F.explode(parents).alias("unit"))
    tree = under.join(roots, ["ft", "unit"]).select("ft", "unit", "member")
    return files.unionByName(hdrs).unionByName(tree).distinct()


def cache_or_build(units: DataFrame, stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Per document: use the stored index (``stored``) unless the file was
    closed before (``seen``), in which case it is rebuilt."""
    st = stored.select("doc_id").distinct().withColumn("_st", F.lit(True))
    sn = seen.select("doc_id").distinct().withColumn("_sn", F.lit(True))
    x = units.join(st, "doc_id", "left").join(sn, "doc_id", "left")
    status = F.when(F.col("_st") & F.col("_sn").isNull(), "stored").otherwise("built")
    return x.select("doc_id", "unit", cache_key("unit", "ft").alias("cache_key"), status.alias("status"))


def new_projects(units: DataFrame, existing: DataFrame, ft: str = "ft") -> DataFrame:
    """Project units not known yet (find-or-create: the anti-join finds the
    ones to create); ``existing`` has ``(ft, unit)``."""
    return units.select(ft, "unit").distinct().join(existing.select(ft, "unit"), [ft, "unit"], "left_anti")


def find_buffers(buffers: DataFrame, ids: DataFrame) -> DataFrame:
    """Buffers whose ``doc_id`` is in ``ids`` (a semi-join; unknown ids give nothing)."""
    return buffers.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
