"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads whole driver tables (or inputs derived from them row by
row), so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import coerce
from tagweave.functions.arrays import splice
from tagweave.functions.paths import basename, cache_key, clean_path, dirname, path_join
from tagweave.functions.text import collapse_blanks, join_lines, strip_source
from tagweave.functions.tokens import distinct_tokens, vim_tokens
from tagweave.operators.edits import replay_edits
from tagweave.operators.events import (
    active_switch,
    coerce_props,
    joined_commands,
    keyword_rollup,
    restore_commands,
    route_events,
    tick_gate,
)
from tagweave.operators.includes import (
    header_closure,
    include_closure,
    resolve_includes,
    resolve_paths,
    sorted_headers,
)
from tagweave.operators.index import normalize_tags, parse_tags
from tagweave.operators.lexer import joined_blocks, line_blocks, strip_blocks
from tagweave.operators.lines import extract_includes, line_dump, lines_range, reconcile
from tagweave.operators.match import first_of_kind, incremental_matches, match_stats, match_tags, token_arrays
from tagweave.operators.ordered import first_occurrence_order
from tagweave.operators.patterns import highlight_commands, kind_patterns
from tagweave.operators.postings import delta_matches, store_matches
from tagweave.operators.projects import (
    admit_buffers,
    cache_or_build,
    filetypes,
    find_buffers,
    find_file,
    longest_prefix,
    project_refs,
    project_units,
    scan_set,
)
from tagweave.operators.regions import drop_if0
from tagweave.operators.sketches import TOP_ERROR, UNIQUE_ERROR, merge_sketches, read_sketches, token_sketches
from tagweave.session import new_folder
from tagweave.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


# ------------------------------------------------------------------ index
@query("raw_tags")
def q_raw_tags(spark, sf):
    return T.raw_tags(spark, sf)


@query("parse_tags")
def q_parse_tags(spark, sf):
    return parse_tags(T.raw_tags(spark, sf))


def _norm_tags(spark, sf, config=T.DEFAULT_CONFIG, langs=("en", "fr", "de", "es")):
    return normalize_tags(parse_tags(T.raw_tags(spark, sf, langs)), config)


def _matches(spark, sf, keep_lang=False):
    return match_tags(T.documents(spark, sf), _norm_tags(spark, sf), keep_lang=keep_lang)


# ------------------------------------------------------------------ tokens
@query("token_set")
def q_token_set(spark, sf):
    d = T.documents(spark, sf, ("doc_id", "text"))
    return d.select("doc_id", F.explode(distinct_tokens("text")).alias("name"))


# ------------------------------------------------------------------ matching
@query("tag_match")
def q_tag_match(spark, sf):
    return _matches(spark, sf)


@query("kind_pattern")
def q_kind_pattern(spark, sf):
    return _commands(spark, T.DEFAULT_CONFIG, _matches(spark, sf, keep_lang=True))


def _commands(spark, cfg, matches):
    pats = kind_patterns(matches)
    kinds = (
        cfg.kind_map(spark)
        .select(F.col("target_lang").alias("lang"), F.col("to_kind").alias("kind"), "pos")
        .distinct()
    )
    out = highlight_commands(pats, cfg.groups_df(spark), F.broadcast(kinds))
    return out.select("doc_id", "kind", F.col("pos").cast("bigint").alias("pos"), "pat", "n", "cmd")


@query("first_of_kind")
def q_first_of_kind(spark, sf):
    return first_of_kind(_matches(spark, sf))


@query("match_stats")
def q_match_stats(spark, sf):
    return match_stats(T.documents(spark, sf), _matches(spark, sf))


@query("lang_family")
def q_lang_family(spark, sf):
    tags = _norm_tags(spark, sf, T.C_CONFIG, ("c", "C++", "java", "es"))
    return match_tags(T.c_documents(spark, sf), tags)


def _c_tags(spark, sf):
    return _norm_tags(spark, sf, T.C_CONFIG, ("c", "C++", "java", "es"))


@query("source_match")
def q_source_match(spark, sf):
    """Code with directives and comments through the whole pipeline."""
    return match_tags(T.source_documents(spark, sf), _c_tags(spark, sf))


@query("command_editor_name")
def q_command_editor_name(spark, sf):
    matches = match_tags(T.c_documents(spark, sf), _c_tags(spark, sf), keep_lang=True)
    return _commands(spark, T.C_CONFIG, matches)


# ------------------------------------------------------------------ text
@query("strip")
def q_strip(spark, sf):
    c = T.code_text(spark, sf)
    return c.select("doc_id", "lang", strip_source("t", "lang").alias("stripped"))


@query("strip_joint")
def q_strip_joint(spark, sf):
    """Comments, literals and regions decided together, texts cut into blocks of lines."""
    stripped = joined_blocks(strip_blocks(line_blocks(T.joint_text(spark, sf), 4096)))
    return stripped.select(F.col("key").alias("doc_id"), "lang", F.col("text").alias("stripped"))


@query("collapse_blanks")
def q_collapse_blanks(spark, sf):
    d = T.documents(spark, sf, ("doc_id", "text"))
    t = F.replace(F.replace("text", F.lit(", "), F.lit(",  \t ")), F.lit("\n"), F.lit("\n  "))
    return d.select("doc_id", collapse_blanks(t).alias("collapsed"))


@query("vim_tokens")
def q_vim_tokens(spark, sf):
    d = T.documents(spark, sf, ("doc_id", "text"))
    t = F.replace("text", F.lit(" "), F.lit(":"))
    return d.select("doc_id", F.explode(F.array_distinct(vim_tokens(t))).alias("name"))


@query("if0_strip")
def q_if0_strip(spark, sf):
    return drop_if0(T.if0_lines(spark, sf)).select("doc_id", "line_no", "line")


@query("include_extract")
def q_include_extract(spark, sf):
    return extract_includes(T.include_lines(spark, sf))


@query("line_dump")
def q_line_dump(spark, sf):
    return line_dump(T.documents(spark, sf, ("doc_id", "text")))


@query("lines_range")
def q_lines_range(spark, sf):
    return lines_range(T.documents(spark, sf, ("doc_id", "text")))


@query("reconcile")
def q_reconcile(spark, sf):
    return reconcile(T.documents(spark, sf, ("doc_id", "n_chars", "text")))


@query("buffer_lines")
def q_buffer_lines(spark, sf):
    d = T.documents(spark, sf, ("doc_id", "text"))
    return d.select("doc_id", join_lines(F.split("text", "\n")).alias("body"))


@query("line_splice")
def q_line_splice(spark, sf):
    d = T.documents(spark, sf, ("doc_id", "n_chars", "text"))
    first = (F.col("doc_id") % 4).cast("int")
    last = first + (F.col("n_chars") % 3).cast("int")
    out = splice(F.split("text", "\n"), first, last, F.array(F.lit("x"), F.lit("y")))
    return d.select("doc_id", F.array_join(out, "\n").alias("edited"))


# ------------------------------------------------------------------ paths
def _page_paths(spark, sf):
    p = T.load(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", "url", F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("path"))


@query("path_parts")
def q_path_parts(spark, sf):
    p = _page_paths(spark, sf)
    d, b = dirname("path"), basename("path")
    return p.select(
        "page_id",
        "path",
        d.alias("dir"),
        b.alias("base"),
        path_join(d, F.lit("."), F.lit("x"), F.lit(".."), b).alias("joined"),
    )


@query("path_clean_deep")
def q_path_clean_deep(spark, sf):
    """Ten segments taken back by ten to thirteen ``..``, with ``.`` and empty segments."""
    p = _page_paths(spark, sf)
    up = F.expr("repeat('/..', cast(10 + page_id % 4 as int))")
    lead = F.when(F.col("page_id") % 2 == 0, "/").otherwise("")
    raw = F.concat(lead, "path", F.lit("/a/b/./c/d//e/f/g/h/i/j"), up, F.lit("/./z//y/"))
    return p.select("page_id", raw.alias("raw")).select("page_id", clean_path("raw").alias("clean"))


@query("cache_key")
def q_cache_key(spark, sf):
    p = T.load(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", cache_key("url", F.lit("html"), "gzip").alias("cache_key"))


# ------------------------------------------------------------------ events
@query("tick_gate")
def q_tick_gate(spark, sf):
    e = T.editor_events(spark, sf)
    kept = tick_gate(e, buf="user_id", tick="tick", force="force", ts="ts", seq="event_id")
    return kept.select("event_id", "user_id", F.col("tick").alias("k"))


@query("active_switch")
def q_active_switch(spark, sf):
    e = T.editor_events(spark, sf).select("event_id", "ts", "user_id", "event_type")
    sw = active_switch(e, session="event_type", buf="user_id", ts="ts", seq="event_id")
    return sw.select("event_id", "event_type", "user_id")


@query("unique_ordered")
def q_unique_ordered(spark, sf):
    e = T.load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return first_occurrence_order(e, "user_id", "event_type", ["ts", "event_id"])


@query("keyword_rollup")
def q_keyword_rollup(spark, sf):
    e = T.load(spark, sf, "events").select("user_id", "event_type")
    return keyword_rollup(e, "user_id", "event_type")


@query("event_route")
def q_event_route(spark, sf):
    e = T.editor_events(spark, sf).select("event_id", "user_id", "name", "tick")
    r = route_events(e, name="name", tick="tick")
    return r.select("event_id", "user_id", "name", "route", "code", "action", "force")


@query("coerce_props")
def q_coerce_props(spark, sf):
    e = T.load(spark, sf, "events").select("event_id", "props")
    return coerce_props(e).select("event_id", "k", "k_bool", "k_str", "keys")


@query("coerce_lists")
def q_coerce_lists(spark, sf):
    j = T.json_values(spark, sf)
    ints = F.transform(coerce.int_list("numbers"), lambda n: n.cast("string"))
    return j.select(
        "event_id",
        F.array_join(coerce.string_list("mixed"), "|").alias("strings"),
        F.array_join(ints, "|").alias("ints"),
        coerce.string_list("letters").isNull().alias("not_a_list"),
    )


@query("coerce_maps")
def q_coerce_maps(spark, sf):
    j = T.json_values(spark, sf)
    text, lists, letters = coerce.string_map("bag"), coerce.string_list_map("bag"), coerce.char_map("letters")
    return j.select(
        "event_id",
        text["n"].alias("n_text"),
        F.array_join(lists["a"], "|").alias("a_list"),
        F.array_join(lists["s"], "|").alias("s_list"),
        lists["n"].isNull().alias("n_not_a_list"),
        letters["v"].alias("v"),
        F.array_join(F.array_sort(F.map_keys(letters)), "").alias("letters"),
    )


@query("keyword_listing")
def q_keyword_listing(spark, sf):
    return joined_commands(restore_commands(T.group_listings(spark, sf)), "owner", "pos")


# ------------------------------------------------------------------ edits
@query("edit_replay")
def q_edit_replay(spark, sf):
    return replay_edits(T.edits(spark, sf))


# ------------------------------------------------------------------ includes
@query("include_resolve")
def q_include_resolve(spark, sf):
    return resolve_includes(T.include_refs(spark, sf), T.manifest(spark, sf))


@query("headers_sorted")
def q_headers_sorted(spark, sf):
    h = sorted_headers(resolve_includes(T.include_refs(spark, sf), T.manifest(spark, sf)))
    return h.select("doc_id", F.array_join("headers", ",").alias("headers"))


@query("include_edges")
def q_include_edges(spark, sf):
    """What every file of the C project includes, from its lines."""
    lines = T.source_lines(spark, sf)
    inc = extract_includes(lines).distinct()
    own = dirname("path")
    files = inc.select(F.col("path").alias("src"), own.alias("own_dir"), "inc", F.array(F.lit(T.HEADER_ROOT), own).alias("search"))
    return resolve_paths(files, lines).select("src", F.col("path").alias("dst")).distinct()


@query("include_closure")
def q_include_closure(spark, sf):
    roots = T.documents(spark, sf, ("doc_id",)).select(F.col("doc_id").alias("root"))
    return include_closure(roots, T.include_edges(spark, sf))


@query("find_file")
def q_find_file(spark, sf):
    m = _page_paths(spark, sf).select("path")
    best = find_file(m)
    d = T.load(spark, sf, "documents").select("doc_id", "n_chars")
    want = d.select("doc_id", (F.col("n_chars") % 1000).cast("string").alias("name"))
    return want.join(best, "name", "left").select("doc_id", "name", "path")


# ------------------------------------------------------------------ projects
@query("longest_prefix")
def q_longest_prefix(spark, sf):
    return longest_prefix(T.page_dirs(spark, sf), "dir", T.page_roots(spark, sf))


@query("longest_prefix_rows")
def q_longest_prefix_rows(spark, sf):
    """Rows without an id: many are equal, and all of them stay."""
    return longest_prefix(T.page_dirs(spark, sf).select("dir"), "dir", T.page_roots(spark, sf))


@query("find_buffers")
def q_find_buffers(spark, sf):
    ids = T.load(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    return find_buffers(T.buffers(spark, sf), ids)


def _admitted(spark, sf):
    b = T.buffers(spark, sf)
    rejected = T.load(spark, sf, "labels").where(F.col("quality") == 0).select("doc_id")
    return admit_buffers(b, filetypes(spark), T.IGNORED_FILETYPES, rejected)


@query("admit_buffers")
def q_admit_buffers(spark, sf):
    return _admitted(spark, sf).select("doc_id", "ft", "ft_id", "status")


def _units(spark, sf):
    a = _admitted(spark, sf).where(F.col("status") == "admitted").select("doc_id", "ft", "filename", "dir")
    return project_units(
        a,
        T.config_list(spark, T.PROJECT_ROOTS),
        T.config_list(spark, T.NORECURSE_DIRS),
    )


@query("project_units")
def q_project_units(spark, sf):
    return _units(spark, sf).select("doc_id", "ft", "root", "recurse", "is_c", "unit")


@query("project_refs")
def q_project_refs(spark, sf):
    return project_refs(_units(spark, sf))


def _header_closure(spark, sf):
    """Headers of the admitted C buffers: search directories are the project root and the own one."""
    c = _units(spark, sf).where("is_c").select(
        "doc_id", F.col("filename").alias("path"), F.array_distinct(F.array("root", "dir")).alias("search")
    )
    return header_closure(c, T.source_lines(spark, sf))


@query("header_closure")
def q_header_closure(spark, sf):
    return _header_closure(spark, sf)


@query("scan_set")
def q_scan_set(spark, sf):
    u = _units(spark, sf).select("doc_id", "ft", "unit", "filename", "is_c", "recurse")
    return scan_set(u, _header_closure(spark, sf).select("doc_id", "path"), T.file_tree(spark, sf))


@query("cache_or_build")
def q_cache_or_build(spark, sf):
    u = _units(spark, sf).select("doc_id", "ft", "unit")
    labels = T.load(spark, sf, "labels").select("doc_id", "toxic")
    stored = labels.select("doc_id")
    seen = labels.where(F.col("toxic") == 1).select("doc_id")
    return cache_or_build(u, stored, seen)


# ------------------------------------------------------------------ incremental
@query("incremental_match")
def q_incremental_match(spark, sf):
    before = T.documents(spark, sf, ("doc_id", "lang", "source", "text", "n_chars"))
    after = T.changed_documents(spark, sf)
    tags = _norm_tags(spark, sf)
    stored = match_tags(before.drop("n_chars"), tags)
    return incremental_matches(stored, before, after, tags)


@query("index_delta_match")
def q_index_delta_match(spark, sf):
    """Documents edited, opened and closed and index rows renamed since the stored run."""
    tags = _norm_tags(spark, sf)
    path = new_folder(spark, "matches")
    before = T.documents(spark, sf, ("doc_id", "lang", "source", "text", "n_chars"))
    store_matches(before, tags, path)
    closed = T.load(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    after = T.changed_documents(spark, sf).join(closed, "doc_id", "left_anti")
    return delta_matches(spark, path, after, T.renamed_tags(tags))


# ------------------------------------------------------------------ approximate counts
@query("token_sketch")
def q_token_sketch(spark, sf):
    """Sketches per document, merged per language and source, held against exact counts."""
    by = ["lang", "source"]
    tokens = token_arrays(T.documents(spark, sf), strip=False)
    own = T.load(spark, sf, "documents").select("doc_id", "source")
    tokens = tokens.join(own, "doc_id")
    # Dealt by document first: no task sorts the tokens of a whole scan (on disk, if they
    # don't fit), and sketches of documents are not shuffled.
    merged = merge_sketches(token_sketches(tokens.repartition("doc_id"), "doc_id", *by), *by)
    guess = read_sketches(merged, *by).withColumnRenamed("unique_tokens", "_unique")

    names = tokens.select(*by, F.explode("toks").alias("name")).groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"))
    slack = F.col("n_tokens") * TOP_ERROR
    least = F.array_min(F.transform("top", lambda t: t["count"]))
    said = F.get(F.filter("top", lambda t: t["item"] == F.col("name")), F.lit(0))["count"]
    # A reported name is near its count; one that is not reported is not above the reported ones.
    right = F.when(said.isNull(), F.col("n") <= least + slack).otherwise(F.abs(said - F.col("n")) <= slack)
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"x.{c}")) for c in by]
    held = names.alias("x").join(guess.alias("g"), same[0] & same[1])
    return held.groupBy("x.lang", "x.source").agg(
        F.first("n_tokens").alias("n_tokens"),
        F.count(F.lit(1)).alias("unique_tokens"),
        (F.abs(F.first("_unique") - F.count(F.lit(1))) <= 5 * UNIQUE_ERROR * F.count(F.lit(1)) + 1).alias("unique_within"),
        F.every(right).alias("top_within"),
    )
