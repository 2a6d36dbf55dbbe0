"""Text cleaning as native column expressions.

Comment and literal stripping is one ``regexp_replace``.  The patterns are
written as unrolled loops with possessive quantifiers so the JVM regex engine
never recurses per character (the textbook ``(?:[^"\\]|\\.)*`` overflows the
thread stack on literals of a few hundred kB).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.constants import C_FAMILY, C_LIKE_LANGS

BLOCK_COMMENT = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
LINE_COMMENT = r"//[^\n]*+"
DQ_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
SQ_STRING = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"
STRIP_REGEX = "|".join([BLOCK_COMMENT, LINE_COMMENT, DQ_STRING, SQ_STRING])

# A blank run after a non-blank byte keeps only its first blank; leading
# indentation (no non-blank byte before it on the line) is kept as is.
COLLAPSE_REGEX = r"([^ \t\n])([ \t])[ \t]+"


def fill(template: str, **parts: Column) -> Column:
    """A ``str.format``-style template with column placeholders, as one native
    ``concat`` (literal pieces stay literals)."""
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            pieces.append(parts[piece])
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_comments(text: Column | str) -> Column:
    """Replace every comment, string and character literal by one blank."""
    return F.regexp_replace(_col(text), STRIP_REGEX, " ")


def collapse_blanks(text: Column | str) -> Column:
    """Collapse runs of blanks/tabs to their first byte, keeping indentation."""
    return F.regexp_replace(_col(text), COLLAPSE_REGEX, "$1$2")


def is_c_like(lang: Column | str) -> Column:
    return _col(lang).isin(*C_LIKE_LANGS)


def strip_source(text: Column | str, lang: Column | str, collapse: bool = False) -> Column:
    """Strip comments/literals for C-like languages; other languages pass through."""
    stripped = strip_comments(text)
    if collapse:
        stripped = collapse_blanks(stripped)
    return F.when(is_c_like(lang), stripped).otherwise(_col(text))


def normalize_lang(lang: Column | str) -> Column:
    """Trim one trailing CR and lower-case (index language field)."""
    return F.lower(F.regexp_replace(_col(lang), "\r$", ""))


def lang_family(lang: Column | str) -> Column:
    """Join key under which C and C++ are one namespace."""
    return F.when(_col(lang).isin(*C_FAMILY), F.lit("c")).otherwise(_col(lang))


def numbered_line(line_no: Column | str, line: Column | str) -> Column:
    """``N:<tab>line`` as in the debug line dump (0-based)."""
    return F.concat(_col(line_no).cast("string"), F.lit(":\t"), _col(line))


def join_lines(lines: Column | str) -> Column:
    """Line form of a buffer: every line followed by a newline."""
    arr = _col(lines)
    return F.when(F.size(arr) > 0, F.concat(F.array_join(arr, "\n"), F.lit("\n"))).otherwise(F.lit(""))
