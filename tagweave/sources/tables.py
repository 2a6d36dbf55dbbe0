"""Driver tables and the inputs derived from them.

Code buffers, index lines, edits and include graphs do not exist in the driver
tables, so they are derived from them by deterministic column expressions.
Every derivation here has a twin in :mod:`tagweave.plans.oracle_sql` so the
results can be checked by an independent engine.  All derivations are
row-local (no shuffle) and grow with the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import literal_table, spread

from tagweave.constants import EVENT_NAMES
from tagweave.functions.tokens import tokens
from tagweave.operators.index import TagConfig

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c) -> "F.Column":
    return c.cast("string")


# ---------------------------------------------------------------- symbol index
DOC_LANGS = ["en", "fr", "de", "es"]
DEFAULT_CONFIG = TagConfig.uniform(
    DOC_LANGS,
    order="cdfm",
    equiv={"t": "c"},
    ignored=["the", "of"],
    groups={
        "c": ("TagClass", None, None),
        "d": ("TagDefine", None, "\\>"),
        "f": ("TagFunction", None, "\\>\\%(\\s*(\\)\\@="),
        "m": ("TagMember", "\\%(\\.\\|->\\)\\@<=", None),
    },
)
C_LANGS = ["c", "c++", "java", "es"]
C_CONFIG = TagConfig.uniform(
    C_LANGS, order="cdfm", equiv={"t": "c"}, ignored=["the", "of"], groups={"d": ("TagDefine", None, None)}
)


def raw_tags(spark: SparkSession, sf_dir: str, lang_names=("en", "fr", "de", "es")) -> DataFrame:
    """Index lines built from the words of ``benchmark``.

    ``name<TAB>src{item%20}<TAB>/^name$/;"<TAB>[7<TAB>]kind<TAB>language:LANG[CR]``
    plus one pseudo line per item.  ``lang_names`` picks the language per
    ``item_id % 4`` (upper-cased in the line).
    """
    b = load(spark, sf_dir, "benchmark").select("item_id", "text")
    item = F.col("item_id")
    kind = F.substr(F.lit("cdfmtv"), (item % 6 + 1).cast("int"), F.lit(1))
    kind = F.when(item % 3 == 0, F.concat(F.lit("7\t"), kind)).otherwise(kind)
    langs = F.array(*[F.lit(x) for x in lang_names])
    lang = F.upper(F.element_at(langs, (item % 4 + 1).cast("int")))
    lang = F.concat(lang, F.when(item % 5 == 0, F.lit("\r")).otherwise(F.lit("")))
    words = b.select("item_id", F.explode(tokens("text")).alias("tok"))
    lines = words.select(
        F.concat_ws(
            "\t",
            F.col("tok"),
            F.concat(F.lit("src"), _s(item % 20)),
            F.concat(F.lit("/^"), F.col("tok"), F.lit('$/;"')),
            kind,
            F.concat(F.lit("language:"), lang),
        ).alias("line")
    )
    pseudo = b.select(F.concat(F.lit("!_TAG_PROGRAM_NAME\tsrc"), _s(item)).alias("line"))
    return lines.unionByName(pseudo)


def documents(spark: SparkSession, sf_dir: str, cols=("doc_id", "lang", "source", "text")) -> DataFrame:
    """Documents, spread over the cluster when the scan is narrow (text work is CPU-heavy)."""
    d = load(spark, sf_dir, "documents").select(*cols)
    return spread(d) if "text" in cols else d


def c_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents re-labelled into C-family buffers: en -> c, fr -> c++."""
    d = documents(spark, sf_dir)
    lang = (
        F.when(F.col("lang") == "en", "c").when(F.col("lang") == "fr", "c++")
        .when(F.col("lang") == "de", "java").otherwise(F.col("lang"))
    )
    return d.select("doc_id", lang.alias("lang"), "source", "text")


# ---------------------------------------------------------------- code text
# (search, replacement) pairs applied in order to inject comments and literals.
CODE_INJECTIONS = [
    (". ", ". /* c. */ "),
    (", ", ' "s,\\" t" , '),
    ("\n", " // eol\n"),
    ("###", "'#' /* a ** b */"),
]
CODE_LANG = {"en": "c", "fr": "c++", "de": "java", "es": "python"}


def code_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, t)``: documents with comments and literals injected."""
    d = spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    t = F.col("text")
    for old, new in CODE_INJECTIONS:
        t = F.replace(t, F.lit(old), F.lit(new))
    code_lang = F.coalesce(
        *[F.when(F.col("lang") == k, F.lit(v)) for k, v in CODE_LANG.items()], F.col("lang")
    )
    return d.select("doc_id", code_lang.alias("lang"), t.alias("t"))


# (search, replacement) pairs: tokens that hold a directive line.  Every one is closed,
# and a region can only end inside a comment, whose end is plain code.
JOINT_INJECTIONS = [
    (", ", " /* x\n#endif\n */ "),
    (". ", ' "s\\"\n#if 0\nt" '),
    ("-", " // e\n"),
]


def joint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, text)``: code whose directives lie in lines of their own (by the line's
    first letter), in comments and in strings."""
    d = spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    plain = F.regexp_replace("text", r"[\"'\\*/#]", "")
    line = lambda x: _directive(F.substr(x, F.lit(1), F.lit(1)), x)
    t = F.array_join(F.transform(F.split(plain, "\n"), line), "\n")
    for old, new in JOINT_INJECTIONS:
        t = F.replace(t, F.lit(old), F.lit(new))
    code_lang = F.coalesce(
        *[F.when(F.col("lang") == k, F.lit(v)) for k, v in CODE_LANG.items()], F.col("lang")
    )
    return d.select("doc_id", code_lang.alias("lang"), t.alias("text"))


# ---------------------------------------------------------------- lines
def doc_lines(spark: SparkSession, sf_dir: str, cols=("doc_id", "lang", "text")) -> DataFrame:
    """``(doc_id, lang, line_no, line)`` with 0-based line numbers."""
    d = spread(load(spark, sf_dir, "documents").select(*cols))
    keep = [c for c in cols if c != "text"]
    lines = d.select(*keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


# Directive injection for the #if 0 operator: a line is rewritten by its first
# letter, so regions, nesting and unbalanced directives all occur.
IF0_REWRITES = [
    ("A", "#if 0"),
    ("E", "#endif"),
    ("T", "#ifdef X"),
    ("O", "  #  if 0"),
    ("I", "#else"),
]


def if0_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, line_no, line)`` of C-family code with directives."""
    lines = doc_lines(spark, sf_dir)
    line = _directive(F.substr(F.col("line"), F.lit(1), F.lit(1)), F.col("line"))
    code_lang = F.coalesce(
        *[F.when(F.col("lang") == k, F.lit(v)) for k, v in CODE_LANG.items()], F.col("lang")
    )
    return lines.select("doc_id", code_lang.alias("lang"), "line_no", line.alias("line"))


def include_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line_no, line)``: every document line rewritten into an
    include directive by ``line_no % 5``: quoted, spaced with a trailing
    comment, indented (not a directive), angle-bracket and empty."""
    lines = doc_lines(spark, sf_dir, ("doc_id", "text"))
    w = F.lower(F.regexp_extract(F.col("line"), "[A-Za-z_][A-Za-z0-9_]*", 0))
    r = F.col("line_no") % 5
    line = (
        F.when(r == 0, F.concat(F.lit('#include "'), w, F.lit('.h"')))
        .when(r == 1, F.concat(F.lit('#  include   "'), w, F.lit('/x.h" // c')))
        .when(r == 2, F.concat(F.lit(' #include "'), w, F.lit('.h"')))
        .when(r == 3, F.concat(F.lit("#include <"), w, F.lit(".h>")))
        .otherwise(F.lit('#include ""'))
    )
    return lines.select("doc_id", "line_no", line.alias("line"))


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, text)``: C-family buffers whose lines hold directives
    (by first letter) and, after every ", ", a comment."""
    d = c_documents(spark, sf_dir)
    line = lambda x: _directive(F.substr(x, F.lit(1), F.lit(1)), x)
    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return d.select("doc_id", "lang", "source", F.replace(text, F.lit(", "), F.lit(" /* x, y */ ")).alias("text"))


def _directive(first, line):
    for letter, directive in reversed(IF0_REWRITES):
        line = F.when(first == letter, F.lit(directive)).otherwise(line)
    return line


# ---------------------------------------------------------------- event stream
# event_type -> editor event name, in the order of the fixed names; "error" stays unknown (quarantined).
EDITOR_EVENT_OF = dict(zip(("view", "click", "purchase", "signup"), (name for name, _ in EVENT_NAMES)))


def editor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an editor change stream: buffer = user, tick = ``props.k``,
    a ``signup`` is a forced refresh, ``event_id`` breaks timestamp ties."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    names = F.create_map(*[F.lit(x) for kv in EDITOR_EVENT_OF.items() for x in kv])
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "props",
        F.coalesce(names[F.col("event_type")], F.col("event_type")).alias("name"),
        k.alias("tick"),
        (F.col("event_type") == "signup").alias("force"),
    )


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, mixed, numbers, bag, letters)``: JSON arrays and objects built from events."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    num, user, kind = _s(F.col("event_id") % 7), _s(F.col("user_id")), F.col("event_type")
    odd = F.when(F.col("event_id") % 3 == 0, "true").otherwise("null")
    return e.select(
        "event_id",
        F.concat(F.lit("["), num, F.lit(',"'), kind, F.lit('",null,"'), user, F.lit('",true]')).alias("mixed"),
        F.concat(F.lit("["), num, F.lit(","), odd, F.lit(","), user, F.lit("]")).alias("numbers"),
        F.concat(F.lit('{"a":["x",1,"'), kind, F.lit('"],"n":'), user, F.lit(',"s":["'), user, F.lit('"]}')).alias("bag"),
        F.concat(F.lit('{"'), kind, F.lit('":"'), user, F.lit('","view":"z"}')).alias("letters"),
    )


def group_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(owner, pos, grp, listing)``: a document's lines as the words of a listed group;
    ``fr`` groups are patterns, ``de`` groups are unknown to the editor."""
    d = documents(spark, sf_dir)
    grp = F.concat(F.lit("g"), _s(F.col("doc_id")))
    words = F.replace("text", F.lit("\n"), F.lit("\n      "))
    head = F.when(F.col("lang") == "fr", " xxx match /").when(F.col("lang") == "de", ": no such group ").otherwise(" xxx ")
    return d.select(
        F.expr("doc_id div 5").alias("owner"),
        F.col("doc_id").alias("pos"),
        grp.alias("grp"),
        F.concat(grp, head, words, F.lit("\n      links to "), F.col("source"), F.lit("\n")).alias("listing"),
    )


# ---------------------------------------------------------------- edits
def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as line edits: buffer = conversation, tick = turn;
    turn 0 replaces the initial empty line, turn t replaces line ``t % 3``."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    t = F.col("turn")
    first = F.when(t == 0, 0).otherwise(t % 3).cast("int")
    last = F.when(t == 0, 1).otherwise(t % 3 + 1).cast("int")
    return c.select(
        F.col("conv_id").alias("buf"),
        t.alias("ctick"),
        first.alias("first"),
        last.alias("last"),
        F.split("text", "\n").alias("lines"),
        F.lit(False).alias("more"),
    )


# ---------------------------------------------------------------- include graph
def include_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, own_dir, inc, search_dirs)``: one include per document; the
    project root is d1 or d8, the search dirs are root and own directory."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    own = F.concat(F.lit("d"), _s(F.col("doc_id") % 7))
    root = F.concat(F.lit("d"), _s(F.col("doc_id") % 2 * 7 + 1))
    return d.select(
        "doc_id",
        own.alias("own_dir"),
        F.concat(F.lit("f"), _s(F.col("n_chars") % 40)).alias("inc"),
        F.array(root, own).alias("search_dirs"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(dir, file)`` of the files that exist."""
    d = load(spark, sf_dir, "documents").select("doc_id")
    return d.select(
        F.concat(F.lit("d"), _s(F.col("doc_id") % 9)).alias("dir"),
        F.concat(F.lit("f"), _s(F.col("doc_id") % 31)).alias("file"),
    )


def include_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst)``: every document includes two others (by id arithmetic
    modulo the document count)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = d.count()
    a = d.select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 2 + 1) % n).alias("dst"))
    b = d.select(F.col("doc_id").alias("src"), (F.col("n_chars") % n).alias("dst"))
    return a.unionByName(b)


HEADER_ROOT = "/w/fr"


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, line)``: the lines of every file of the C project.

    Each document is a header ``h<id % 3>/f<id>.h`` under the project root, those
    in French are buffers as well.  A line is an include directive whose target
    follows from its document, number and length; ``line_no % 5`` gives its form.
    """
    d = documents(spark, sf_dir)
    header = F.concat(F.lit(f"{HEADER_ROOT}/h"), _s(F.col("doc_id") % 3), F.lit("/f"), _s(F.col("doc_id")), F.lit(".h"))
    buffer = F.concat(F.lit("/w/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/f"), _s(F.col("doc_id")), F.lit(".txt"))
    paths = F.when(F.col("lang") == "fr", F.array(header, buffer)).otherwise(F.array(header))
    lines = d.select("doc_id", paths.alias("paths"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    size, id_ = F.char_length("line"), F.col("doc_id")
    far, own, any_ = (id_ * 2 + size) % 500, (id_ + 3 * size) % 600, (id_ * 7 + size) % 400
    form = F.col("line_no") % 5
    line = (
        F.when(form == 0, F.concat(F.lit('#include "h'), _s(far % 3), F.lit("/f"), _s(far), F.lit('.h"')))
        .when(form == 1, F.concat(F.lit('#  include   "f'), _s(own), F.lit('.h" // c')))
        .when(form == 2, F.concat(F.lit(' #include "f'), _s(own), F.lit('.h"')))
        .when(form == 3, F.concat(F.lit("#include <../h"), _s(any_ % 3), F.lit("/f"), _s(any_), F.lit(".h>")))
        .otherwise(F.lit('#include ""'))
    )
    return lines.select(F.explode("paths").alias("path"), line.alias("line"))


# ---------------------------------------------------------------- buffers and projects
BUFFER_FT = {"en": "python", "fr": "cpp", "de": "vim", "es": "es"}
IGNORED_FILETYPES = ["vim"]
PROJECT_ROOTS = ["/w/en", "/w/fr", "/w/en/src1", "/w/es/src2"]
NORECURSE_DIRS = ["/w/en/src1", "/w/es/src2"]


def buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, ft, filename, dir)``: documents as editor buffers."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    ft = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in BUFFER_FT.items()], F.col("lang"))
    dir_ = F.concat(F.lit("/w/"), F.col("lang"), F.lit("/"), F.col("source"))
    return d.select(
        "doc_id",
        ft.alias("ft"),
        F.concat(dir_, F.lit("/f"), _s(F.col("doc_id")), F.lit(".txt")).alias("filename"),
        dir_.alias("dir"),
    )


def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, ft)`` of every file that exists, open as a buffer or not."""
    return buffers(spark, sf_dir).select(F.col("filename").alias("path"), "ft")


def config_list(spark: SparkSession, values: list[str], col: str = "root") -> DataFrame:
    """A settings list as a one-column broadcast table (size bounded by the settings)."""
    return F.broadcast(literal_table(spark, [(v,) for v in values], f"{col} string"))


def page_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, dir)``: the directory part of each page url (no query)."""
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    nq = F.regexp_replace("url", "[?#].*$", "")
    return p.select("page_id", F.regexp_extract(nq, "^(.*)/[^/]*$", 1).alias("dir"))


def page_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project roots taken from pages: hosts of urls with a query and
    host/language dirs of urls with a fragment."""
    p = load(spark, sf_dir, "pages").select("url")
    hosts = p.where(F.col("url").contains("?")).select(
        F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("root")
    )
    langs = p.where(F.col("url").contains("#")).select(
        F.regexp_extract("url", "^[a-z]+://[^/]+/[a-z]+", 0).alias("root")
    )
    return hosts.unionByName(langs)


def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second snapshot: documents labelled quality 1 are edited (``e`` -> ``a``)
    and their tick (``n_chars``) moves by one."""
    d = documents(spark, sf_dir, ("doc_id", "lang", "source", "text", "n_chars"))
    good = (
        load(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id").distinct()
        .withColumn("_chg", F.lit(True))
    )
    x = d.join(good, "doc_id", "left")
    chg = F.coalesce(F.col("_chg"), F.lit(False))
    return x.select(
        "doc_id", "lang", "source",
        F.when(chg, F.replace("text", F.lit("e"), F.lit("a"))).otherwise(F.col("text")).alias("text"),
        F.when(chg, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def renamed_tags(norm_tags: DataFrame) -> DataFrame:
    """A second index: names whose length divides by five lose their last character."""
    name = F.when(F.length("name") % 5 == 0, F.expr("left(name, length(name) - 1)")).otherwise(F.col("name"))
    return norm_tags.withColumn("name", name)
