"""Identifier extraction as native column expressions (no Python UDF).

The character tests of the original tokenizer are compiled into one regular
expression, so tokenizing runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: identifier character classes (ASCII only) ---
ID_FIRST = "A-Za-z_"
ID_REST = "A-Za-z0-9_"
VIM_REST = "A-Za-z0-9_:"


def token_regex(first_class: str = ID_FIRST, rest_class: str = ID_REST) -> str:
    """Regex for one token: one ``first_class`` byte then any ``rest_class`` bytes."""
    return f"[{first_class}][{rest_class}]*"


ID_REGEX = token_regex()
VIM_ID_REGEX = token_regex(ID_FIRST, VIM_REST)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, first_class: str = ID_FIRST, rest_class: str = ID_REST) -> Column:
    """All identifier occurrences of ``text`` in order (array<string>)."""
    return F.regexp_extract_all(_col(text), F.lit(token_regex(first_class, rest_class)), 0)


def distinct_tokens(text: Column | str, **kw) -> Column:
    """The token set of ``text`` (array<string>, no duplicates)."""
    return F.array_distinct(tokens(text, **kw))


def vim_tokens(text: Column | str) -> Column:
    """Vim-script tokens: ``:`` allowed after the first byte; for every token
    holding a ``:`` the part after the first ``:`` is emitted as well."""
    toks = F.regexp_extract_all(_col(text), F.lit(VIM_ID_REGEX), 0)
    tails = F.transform(
        F.filter(toks, lambda t: F.instr(t, ":") > 0),
        lambda t: F.substr(t, F.instr(t, ":") + 1),
    )
    return F.concat(toks, tails)


def tokens_by_lang(text: Column | str, lang: Column | str) -> Column:
    """Token array chosen by language (native ``CASE``, no UDF)."""
    return F.when(_col(lang) == F.lit("vim"), vim_tokens(text)).otherwise(tokens(text))
