"""Match every document against the symbol index.

A tag is kept for a document when the languages agree and the tag is either
defined in the document's own file or its name occurs as a token of the
(stripped) document.  The disjunction is planned as one equi-join of all that a
document asks for (names, and its file) followed by one distinct: an ``OR`` join
condition would plan as a nested-loop join over (documents x tags).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.tokens import tokens_by_lang
from tagweave.operators.lexer import strip_joint

#: Rows up to which an index goes to every task (some 15 MB).
SMALL_INDEX = 100_000


def document_tokens(docs: DataFrame, text: str = "text", lang: str = "lang", strip: bool = True) -> DataFrame:
    """``(doc_id, lang, name)``: the token set of every document (vim buffers
    use the vim tokenizer, all others the C one).

    A document is one row, so de-duplicating inside the row's array needs no
    shuffle; the explode runs in the scan stage.
    """
    toks = F.array_distinct(F.col("toks"))
    return token_arrays(docs, text, lang, strip).select("doc_id", "lang", F.explode(toks).alias("name"))


def token_arrays(
    docs: DataFrame, text: str = "text", lang: str = "lang", strip: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(doc_id, lang, keep, toks)``: token occurrences of the text that is left after
    ``#if 0`` regions (C family), comments and literals (C-like) are gone, all
    decided by one lexer."""
    clean = docs.select("doc_id", F.col(lang).alias("lang"), *keep, F.col(text).alias("_body"))
    if strip:
        clean = strip_joint(clean, "_body", "lang")
    return clean.select("doc_id", "lang", *keep, tokens_by_lang("_body", "lang").alias("toks"))


def is_small(index: DataFrame) -> bool:
    """Whether the index has at most ``SMALL_INDEX`` rows; they are counted, not estimated."""
    return index.limit(SMALL_INDEX + 1).count() <= SMALL_INDEX


def match_tags(
    docs: DataFrame,
    norm_tags: DataFrame,
    source: str = "source",
    strip: bool = True,
    keep_lang: bool = False,
) -> DataFrame:
    """``(doc_id, name, kind)`` distinct matches (``lang`` too if ``keep_lang``;
    it is a function of ``doc_id`` so it does not change the distinct).

    ``docs``: ``(doc_id, lang, source, text)``; ``norm_tags``: output of
    :func:`tagweave.operators.index.normalize_tags`.
    """
    # A document asks for its tokens and for its file in one list, so what meets the
    # index is dealt by text: the files alone are so little that one task would get them
    # all, and each meets all of its tags.
    nt = norm_tags.select(F.col("target_lang").alias("lang"), "name", "file", "kind").distinct()
    small = is_small(nt)
    by_name = nt.select("lang", F.lit(False).alias("own"), F.col("name").alias("key"), "name", "kind").distinct()
    by_file = nt.select("lang", F.lit(True).alias("own"), F.col("file").alias("key"), "name", "kind")
    index = by_name.unionByName(by_file)

    rows = docs.select("doc_id", "lang", F.col(source).alias("_file"), "text")
    ask = lambda own, key: F.struct(F.lit(own).alias("own"), key.alias("key"))
    toks = F.coalesce(F.array_distinct("toks"), F.array().cast("array<string>"))
    asks = F.concat(F.transform(toks, lambda t: ask(False, t)), F.array(ask(True, F.col("_file"))))
    asked = token_arrays(rows, strip=strip, keep=("_file",)).select("doc_id", "lang", F.inline(asks))
    out = ["doc_id", "lang", "name", "kind"] if keep_lang else ["doc_id", "name", "kind"]
    # A small index is broadcast and no token is shuffled; else a plain equi-join, whose
    # hot names are split by the adaptive planner.
    matches = asked.join(F.broadcast(index) if small else index, ["lang", "own", "key"]).select(*out)
    # One clustering by document serves this distinct and every rollup of the
    # matches by document and kind; a document's matches are bounded by its text
    # and its file's tags.
    return matches.repartition("doc_id").distinct()


def match_stats(docs: DataFrame, matches: DataFrame, text: str = "text") -> DataFrame:
    """Per document: token occurrences, distinct tokens and distinct matches,
    counted on the same tokens that are matched."""
    per_doc = token_arrays(docs, text).select(
        "doc_id",
        F.size("toks").cast("bigint").alias("total_tokens"),
        F.size(F.array_distinct("toks")).cast("bigint").alias("unique_tokens"),
    )
    counts = matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unique_tags"))
    return per_doc.join(counts, "doc_id", "left").select(
        "doc_id",
        "total_tokens",
        "unique_tokens",
        F.coalesce("unique_tags", F.lit(0)).cast("bigint").alias("unique_tags"),
    )


def first_of_kind(matches: DataFrame) -> DataFrame:
    """First match per (doc, kind) in pattern order (byte length, then bytes).

    An aggregate (``min_by``) rather than ``row_number`` over a window: the
    partial aggregate runs map-side, so a hot document is reduced before the
    shuffle.
    """
    order_key = F.struct(F.octet_length("name").alias("len"), F.col("name").alias("name"))
    return matches.groupBy("doc_id", "kind").agg(F.min_by("name", order_key).alias("first_name"))


def incremental_matches(
    stored: DataFrame, before: DataFrame, after: DataFrame, norm_tags: DataFrame, tick: str = "n_chars"
) -> DataFrame:
    """Matches of ``after`` reusing ``stored`` (the matches of ``before``):
    only documents whose tick moved, or that are new, are recomputed."""
    prev = before.select("doc_id", F.col(tick).alias("_prev_tick"))
    moved = (
        after.join(prev, "doc_id", "left")
        .where(F.col("_prev_tick").isNull() | (F.col("_prev_tick") != F.col(tick)))
        .drop("_prev_tick", tick)
    )
    gone = before.select("doc_id").join(after.select("doc_id"), "doc_id", "left_anti")
    keep = stored.join(moved.select("doc_id"), "doc_id", "left_anti").join(gone, "doc_id", "left_anti")
    fresh = match_tags(moved, norm_tags)
    return keep.unionByName(fresh)
