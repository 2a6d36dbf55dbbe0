"""Native array editing of line arrays (no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def splice(arr: Column | str, first: Column | str, last: Column | str, repl: Column | str) -> Column:
    """Elements ``[first, last)`` (0-based) of ``arr`` replaced by ``repl``;
    out-of-range positions clamp to the end, and an empty result becomes one
    empty line."""
    a, f, l, r = _col(arr), _col(first), _col(last), _col(repl)
    n = F.size(a)
    head = F.slice(a, F.lit(1), F.least(f, n))
    tail_start = F.least(F.greatest(l, f), n) + 1
    tail = F.slice(a, tail_start, F.greatest(n - tail_start + 1, F.lit(0)))
    out = F.concat(head, r, tail)
    return F.when(F.size(out) == 0, F.array(F.lit(""))).otherwise(out)


def insert_before(arr, pos, items):
    return splice(arr, pos, pos, items)


def delete_range(arr, first, last):
    return splice(arr, first, last, F.array().cast("array<string>"))


def replace_at(arr, pos, item):
    return splice(arr, pos, _col(pos) + 1, F.array(_col(item)))
