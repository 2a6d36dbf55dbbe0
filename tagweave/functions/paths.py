"""Path helpers as column expressions (no file-system access)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.constants import CACHE_SUFFIXES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dirname(path: Column | str) -> Column:
    """Directory part: everything before the last ``/`` ("." when there is none,
    "/" for a top-level absolute path)."""
    p = _col(path)
    head = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return (
        F.when(~p.contains("/"), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def path_join(*parts: Column | str) -> Column:
    return clean_path(F.concat_ws("/", *[_col(p) for p in parts]))


def clean_path(path: Column | str) -> Column:
    """Lexical clean-up: empty and ``.`` segments go, ``..`` takes back the segment
    before it (at the root it is dropped, in a relative path it stays).

    One fold over the segments with a stack, so any nesting is resolved.
    """
    p = _col(path)
    rooted = p.startswith("/")

    def push(stack: Column, part: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        pops = (F.size(stack) > 0) & (top != "..")
        return (
            F.when(part.isin("", "."), stack)
            .when((part == "..") & pops, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .when((part == "..") & rooted, stack)
            .otherwise(F.concat(stack, F.array(part)))
        )

    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), push)
    joined = F.array_join(parts, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def cache_key(root: Column | str, editor_name: Column | str, comp: str = "gzip") -> Column:
    """Index store name for a project unit: ``/``, ``:`` and ``\\`` become ``__``."""
    mangled = F.regexp_replace(_col(root), r"[/:\\]", "__")
    return F.concat(mangled, F.lit("."), _col(editor_name), F.lit(CACHE_SUFFIXES[comp]))
