"""Symbol index: parse raw index lines, apply per-language kind/ignore config.

Raw lines are ``name<TAB>file<TAB>...<TAB>kind<TAB>language:LANG``.  The kind is
the last one-byte field after the second; the language the last
``language:`` field.  All of it is split/filter on arrays, inside codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.constants import C_FAMILY, LANGUAGE_FIELD, PSEUDO_TAG_PREFIX
from tagweave.functions.text import normalize_lang
from tagweave.session import literal_table


def skip_pseudo(raw: DataFrame, line: str = "line") -> DataFrame:
    """Drop blank rows and ``!`` pseudo rows."""
    return raw.where((F.length(line) > 0) & ~F.startswith(F.col(line), F.lit(PSEUDO_TAG_PREFIX)))


def _fields(line: str):
    return F.split(F.col(line), "\t")


def parse_tags(raw: DataFrame, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """Raw index lines -> ``(name, file, kind, lang)`` (+ ``keep`` columns).

    Rows without a one-byte kind or without a language are dropped, as are rows
    with fewer than two fields (see :func:`quarantine_tags`).
    """
    keep = keep or []
    p = F.col("_p")
    rest = F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(1)))
    rest = F.when(F.size(p) > 2, rest).otherwise(F.array().cast("array<string>"))
    kind = F.try_element_at(F.filter(rest, lambda x: F.octet_length(x) == 1), F.lit(-1))
    lang_fields = F.filter(rest, lambda x: F.startswith(x, F.lit(LANGUAGE_FIELD)))
    lang_raw = F.substr(F.try_element_at(lang_fields, F.lit(-1)), F.lit(len(LANGUAGE_FIELD) + 1))
    parsed = (
        skip_pseudo(raw, line)
        .select(*keep, _fields(line).alias("_p"))
        .where(F.size("_p") >= 2)
        .select(
            *keep,
            p[0].alias("name"),
            p[1].alias("file"),
            kind.alias("kind"),
            lang_raw.alias("_lang_raw"),
        )
        # the language test is on bytes: an empty value is no language
        .where(F.col("kind").isNotNull() & (F.coalesce(F.length("_lang_raw"), F.lit(0)) > 0))
        .select(*keep, "name", "file", "kind", normalize_lang("_lang_raw").alias("lang"))
    )
    return parsed


def quarantine_tags(raw: DataFrame, line: str = "line") -> DataFrame:
    """Rows the original tool would crash on (fewer than two fields)."""
    return (
        skip_pseudo(raw, line)
        .where(F.size(_fields(line)) < 2)
        .select(F.col(line).alias("line"), F.lit("fewer than two fields").alias("reason"))
    )


@dataclass
class TagConfig:
    """Per-language highlight configuration.

    ``order``: admitted kinds, in display order; ``equiv``: one-step kind
    mapping applied before the order test; ``ignored``: names never
    highlighted; ``groups``: kind -> (group, prefix, suffix).
    """

    order: dict[str, str]
    equiv: dict[str, dict[str, str]] = field(default_factory=dict)
    ignored: dict[str, list[str]] = field(default_factory=dict)
    groups: dict[str, dict[str, tuple[str, str | None, str | None]]] = field(default_factory=dict)

    @classmethod
    def uniform(cls, langs, order, equiv=None, ignored=None, groups=None) -> "TagConfig":
        return cls(
            order={lang: order for lang in langs},
            equiv={lang: dict(equiv or {}) for lang in langs},
            ignored={lang: list(ignored or []) for lang in langs},
            groups={lang: dict(groups or {}) for lang in langs},
        )

    # Small dimension tables: their size is bounded by the configuration
    # (languages x kinds), so they are broadcast explicitly.
    def kind_map(self, spark: SparkSession) -> DataFrame:
        rows = []
        for lang, order in self.order.items():
            equiv = self.equiv.get(lang, {})
            raw_kinds = sorted(set(order) | set(equiv))
            for k in raw_kinds:
                to = equiv.get(k, k)
                if to in order:
                    rows.append((lang, k, to, order.index(to)))
        return F.broadcast(
            literal_table(spark, rows, "target_lang string, kind string, to_kind string, pos int")
        )

    def ignored_df(self, spark: SparkSession) -> DataFrame:
        rows = [(lang, n) for lang, names in self.ignored.items() for n in names]
        return F.broadcast(literal_table(spark, rows, "target_lang string, name string"))

    def groups_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (lang, k, g, pre, suf)
            for lang, kinds in self.groups.items()
            for k, (g, pre, suf) in kinds.items()
        ]
        return F.broadcast(
            literal_table(spark, rows, "lang string, kind string, grp string, prefix string, suffix string")
        )


def target_langs(lang_col: str = "lang"):
    """Buffer languages that accept a tag of ``lang``: itself, and for the C
    family every member (a C project takes C and C++ tags)."""
    lang = F.col(lang_col)
    family = F.array(*[F.lit(x) for x in C_FAMILY])
    return F.when(lang.isin(*C_FAMILY), family).otherwise(F.array(lang))


def normalize_tags(tags: DataFrame, config, c_family: bool = True) -> DataFrame:
    """Apply kind mapping, kind admission and the ignore list.

    Output ``(target_lang, name, file, kind)``: ``target_lang`` is the buffer
    language the row is valid for (a C++ tag yields rows for C and C++ when
    ``c_family``); ``kind`` is the mapped kind.  ``config`` is a
    :class:`TagConfig` or a ``(kind_map, ignored)`` pair of DataFrames (e.g.
    from :mod:`tagweave.sources.settings`).
    """
    spark = tags.sparkSession
    expanded = tags.select(
        "name",
        "file",
        "kind",
        F.explode(target_langs("lang") if c_family else F.array(F.col("lang"))).alias(
            "target_lang"
        ),
    )
    if isinstance(config, TagConfig):
        kinds, ignored = config.kind_map(spark), config.ignored_df(spark)
    else:
        kinds, ignored = config
    out = (
        expanded.join(kinds, ["target_lang", "kind"], "inner")
        .join(ignored, ["target_lang", "name"], "left_anti")
        .select("target_lang", "name", "file", F.col("to_kind").alias("kind"))
    )
    return out
