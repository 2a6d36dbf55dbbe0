"""Settings source: a JSON settings document as broadcastable dimension tables.

The settings map languages to their kind order string, one-step kind
equivalences, ignored names and highlight groups::

    {"order": {"c": "cdfm"}, "equivalent": {"c": {"t": "c"}},
     "ignored": {"c": ["the"]}, "groups": {"c": {"f": {"group": "G", "prefix": null}}}}

Everything is exploded into rows by Spark (nothing is collected to the
driver); the tables are bounded by the settings size, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS_SCHEMA = (
    "order map<string,string>, equivalent map<string,map<string,string>>, "
    "ignored map<string,array<string>>, "
    "groups map<string,map<string,struct<group:string,prefix:string,suffix:string>>>"
)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SETTINGS_SCHEMA).option("multiLine", True).json(path)


def kind_map_from_settings(settings: DataFrame) -> DataFrame:
    """``(target_lang, kind, to_kind, pos)``: raw kinds admitted after one
    equivalence step, with the display position of the mapped kind."""
    order = settings.select(F.explode("order").alias("target_lang", "order"))
    kinds = order.select(
        "target_lang", "order",
        F.posexplode(F.split("order", "")).alias("pos", "to_kind"),
    ).where(F.length("to_kind") > 0)
    equiv = settings.select(F.explode("equivalent").alias("target_lang", "m")).select(
        "target_lang", F.explode("m").alias("kind", "to_kind")
    )
    identity = kinds.select("target_lang", F.col("to_kind").alias("kind"), "to_kind", "pos")
    mapped = equiv.join(kinds.select("target_lang", "to_kind", "pos"), ["target_lang", "to_kind"])
    # an equivalence overrides the identity entry of the same raw kind
    identity = identity.join(equiv.select("target_lang", "kind"), ["target_lang", "kind"], "left_anti")
    out = identity.unionByName(mapped.select("target_lang", "kind", "to_kind", "pos"))
    return F.broadcast(out.select("target_lang", "kind", "to_kind", F.col("pos").cast("int")))


def ignored_from_settings(settings: DataFrame) -> DataFrame:
    return F.broadcast(
        settings.select(F.explode("ignored").alias("target_lang", "names")).select(
            "target_lang", F.explode("names").alias("name")
        )
    )


def groups_from_settings(settings: DataFrame) -> DataFrame:
    g = settings.select(F.explode("groups").alias("lang", "m")).select(
        "lang", F.explode("m").alias("kind", "g")
    )
    return F.broadcast(
        g.select("lang", "kind", F.col("g.group").alias("grp"), F.col("g.prefix").alias("prefix"),
                 F.col("g.suffix").alias("suffix"))
    )
