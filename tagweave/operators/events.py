"""Change-event operators: gating, buffer switches, routing, coercion, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.constants import EVENT_NAMES, FORCE_CODE, RESTORE_COMMAND, UPDATE_CODES
from tagweave.functions.text import fill
from tagweave.operators.ordered import ordered_lag


def tick_gate(
    events: DataFrame,
    buf: str = "buf",
    tick: str = "tick",
    force: str = "force",
    ts: str = "ts",
    seq: str = "seq",
) -> DataFrame:
    """Keep events whose tick differs from the last processed one (initially
    0) or that are forced.  The last processed tick always equals the
    previous event's tick, so this is a lag per buffer, a hot buffer in ranges."""
    x = ordered_lag(events, [buf], [ts, seq], [tick], prefix="_prev_")
    prev = F.coalesce("_prev_" + tick, F.lit(0))
    return x.where(F.col(force) | (F.col(tick) != prev)).drop("_prev_" + tick, "has_prev")


def active_switch(
    events: DataFrame,
    session: str = "session",
    buf: str = "buf",
    ts: str = "ts",
    seq: str = "seq",
) -> DataFrame:
    """Events where the current buffer differs from the previous event's
    buffer in the same session (initially none)."""
    x = ordered_lag(events, [session], [ts, seq], [buf])
    changed = ~F.col("has_prev") | (F.col(buf) != F.col("prev_" + buf))
    return x.where(changed).drop("prev_" + buf, "has_prev")


def route_events(events: DataFrame, name: str = "name", tick: str = "tick") -> DataFrame:
    """Classify events by name; unknown names route to ``quarantine``.  Update
    events carry a one-letter code (derived from the tick) and its action.

    Lookups are literal maps inside the projection: no join, no shuffle."""
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_NAMES for x in pair])
    actions = F.create_map(*[F.lit(x) for pair in UPDATE_CODES for x in pair])
    letters = "".join(c for c, _ in UPDATE_CODES)
    route = F.coalesce(kinds[F.col(name)], F.lit("quarantine"))
    code = F.when(
        route == "update",
        F.substr(F.lit(letters), (F.col(tick) % len(letters) + 1).cast("int"), F.lit(1)),
    )
    return events.select(
        "*",
        route.alias("route"),
        code.alias("code"),
        actions[code].alias("action"),
        F.coalesce(code == F.lit(FORCE_CODE), F.lit(False)).alias("force"),
    )


def coerce_props(events: DataFrame, props: str = "props", key: str = "k") -> DataFrame:
    """Typed views of a dynamic JSON property bag.

    number -> bigint; number -> bool only for 0/1 (others null, where a plain
    cast would turn 2 into true); the object's keys, in document order.
    """
    # Rebuilding the map through map_from_entries applies the session's
    # LAST_WIN key policy: a later duplicate key overwrites an earlier one.
    m = F.map_from_entries(F.map_entries(F.from_json(F.col(props), "map<string,string>")))
    k_str = m[key]
    k = k_str.try_cast("bigint")
    k_bool = F.when(k == 0, F.lit(False)).when(k == 1, F.lit(True))
    return events.select(
        "*",
        k.alias("k"),
        k_bool.alias("k_bool"),
        k_str.alias("k_str"),
        F.array_join(F.json_object_keys(F.col(props)), ",").alias("keys"),
    )


def keyword_rollup(df: DataFrame, group: str, keyword: str, link: str = "Identifier") -> DataFrame:
    """Per group: distinct keywords sorted descending (bytewise), space-joined,
    and the restore command ``syntax clear G | syntax keyword G ... | hi! link G L``.

    The (group, keyword) distinct is a partial aggregate, so the per-group
    list holds each keyword once however hot the group is.
    """
    kw = (
        df.where(F.col(keyword).isNotNull())
        .select(group, keyword)
        .distinct()
        .groupBy(group)
        .agg(F.array_join(F.sort_array(F.collect_list(keyword), asc=False), " ").alias("keywords"))
    )
    g = F.concat(F.lit("grp_"), F.col(group).cast("string"))
    cmd = fill(RESTORE_COMMAND, group=g, words=F.col("keywords"), link=F.lit(link))
    return kw.select(group, "keywords", cmd.alias("cmd"))


def restore_commands(listings: DataFrame, group: str = "grp", listing: str = "listing") -> DataFrame:
    """``listings`` with ``cmd``: the command that restores a group from the editor's
    listing of it (``<group> xxx word ... links to <link>``, words on lines).

    Null where there is nothing to restore: no such group, a pattern or region
    group, or no link.  Words are distinct, in descending byte order.
    """
    at = F.instr(listing, "xxx")
    body = F.substr(F.col(listing), at + 4)
    skip = (at == 0) | body.startswith("match /") | body.startswith("start")
    link = F.regexp_extract(body, r"\n[ \t\r\n]*links to (\S+)", 1)
    lines = F.split(F.regexp_extract(body, r"(?s)^(.*?)\n[ \t\r\n]*links to ", 1), r"\n[ \t\r\n]*")
    words = F.sort_array(F.array_distinct(F.filter(lines, lambda w: w != "")), asc=False)
    cmd = fill(RESTORE_COMMAND, group=F.col(group), words=F.array_join(words, " "), link=link)
    return listings.withColumn("cmd", F.when(~skip & (link != ""), cmd))


def joined_commands(commands: DataFrame, owner: str, position: str) -> DataFrame:
    """``(owner, cmds)``: an owner's commands in order, joined by `` | ``; an owner
    has as many as its settings list groups."""
    kept = commands.where(F.col("cmd").isNotNull()).groupBy(owner).agg(
        F.sort_array(F.collect_list(F.struct(position, "cmd"))).alias("all")
    )
    return kept.select(owner, F.array_join(F.transform("all", lambda c: c["cmd"]), " | ").alias("cmds"))
