"""Roll matches up into one highlight pattern / command per (document, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.constants import (
    DEFAULT_PREFIX,
    DEFAULT_SUFFIX,
    FILETYPES,
    GROUP_PREFIX,
    KEYWORD_COMMAND,
    MATCH_COMMAND,
    PATTERN_SEPARATOR,
)
from tagweave.functions.text import fill

# Names in pattern order: byte length first, then bytes (UTF8_BINARY).
_ORDERED_NAMES = (
    "listagg(name, '{sep}') WITHIN GROUP (ORDER BY octet_length(name), name)"
)


def kind_patterns(matches: DataFrame) -> DataFrame:
    """``(doc_id, [lang,] kind, pat, n)``: names joined by ``\\|`` in pattern order.

    The pattern is built in two aggregation levels: names are first joined per
    (doc, kind, byte length) -- that partial work is spread over many tasks even
    for one huge document -- and the per-length pieces are then concatenated in
    length order.  The final row holds exactly the output value.
    """
    sep = PATTERN_SEPARATOR.replace("\\", "\\\\")
    keys = ["doc_id", "lang", "kind"] if "lang" in matches.columns else ["doc_id", "kind"]
    by_len = matches.groupBy(*keys, F.octet_length("name").alias("len")).agg(
        F.expr(_ORDERED_NAMES.format(sep=sep)).alias("piece"),
        F.count(F.lit(1)).alias("cnt"),
    )
    return by_len.groupBy(*keys).agg(
        F.expr(f"listagg(piece, '{sep}') WITHIN GROUP (ORDER BY len)").alias("pat"),
        F.sum("cnt").cast("bigint").alias("n"),
    )


def editor_name(lang: str = "lang") -> Column:
    """The editor's filetype name of an index language (``c++`` is ``cpp``); others as they are."""
    names = F.create_map(*[F.lit(x) for _, ft, index in FILETYPES for x in (index, ft)])
    return F.coalesce(names[F.col(lang)], F.col(lang))


def highlight_commands(patterns: DataFrame, groups: DataFrame, kinds: DataFrame) -> DataFrame:
    """Full highlight command per (doc, kind).

    ``groups``: ``(lang, kind, grp, prefix, suffix)``; when both prefix and
    suffix are null the keyword form is used, else the match form with the
    default prefix/suffix filling the missing one.  ``kinds`` gives the display
    position ``pos`` of each kind.  Both are small broadcast dimensions.
    """
    gid = F.concat_ws("_", F.lit(GROUP_PREFIX), editor_name(), F.col("kind"), F.col("grp"))
    match_cmd = fill(
        MATCH_COMMAND,
        gid=gid,
        prefix=F.coalesce("prefix", F.lit(DEFAULT_PREFIX)),
        pat=F.col("pat"),
        suffix=F.coalesce("suffix", F.lit(DEFAULT_SUFFIX)),
        group=F.col("grp"),
    )
    keyword_cmd = fill(
        KEYWORD_COMMAND,
        gid=gid,
        words=F.replace(F.col("pat"), F.lit(PATTERN_SEPARATOR), F.lit(" ")),
        group=F.col("grp"),
    )
    both_null = F.col("prefix").isNull() & F.col("suffix").isNull()
    # A kind without a configured group still gets its command (empty group).
    return (
        patterns.join(groups, ["lang", "kind"], "left")
        .withColumn("grp", F.coalesce("grp", F.lit("")))
        .join(kinds, ["lang", "kind"], "inner")
        .select(
            "doc_id", "kind", "pos", "pat", "n",
            F.when(both_null, keyword_cmd).otherwise(match_cmd).alias("cmd"),
        )
    )
