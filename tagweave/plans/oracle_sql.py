"""DuckDB SQL twins of the registered queries (independent correctness oracle).

Each entry runs against the driver tables registered as views.  The derived
inputs of :mod:`tagweave.sources.tables` are restated here as CTEs.
"""

from __future__ import annotations

ID = "[A-Za-z_][A-Za-z0-9_]*"

RAW_TAGS = f"""
raw_tags AS (
  SELECT concat_ws(chr(9), tok, 'src' || (item_id % 20), '/^' || tok || '$/;"',
           CASE WHEN item_id % 3 = 0 THEN '7' || chr(9) ELSE '' END
             || substr('cdfmtv', CAST(item_id % 6 + 1 AS INTEGER), 1),
           'language:' || upper({{langs}}[CAST(item_id % 4 + 1 AS INTEGER)])
             || CASE WHEN item_id % 5 = 0 THEN chr(13) ELSE '' END) AS line
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '{ID}')) AS tok FROM benchmark)
  UNION ALL
  SELECT '!_TAG_PROGRAM_NAME' || chr(9) || 'src' || item_id FROM benchmark
)"""

PARSED_TAGS = """
tag_fields AS (
  SELECT string_split(line, chr(9)) AS p FROM raw_tags
  WHERE length(line) > 0 AND NOT starts_with(line, '!')
),
tag_rows AS (
  SELECT p[1] AS name, p[2] AS file,
         list_filter(p[3:], lambda x: strlen(x) = 1)[-1] AS kind,
         list_filter(p[3:], lambda x: starts_with(x, 'language:'))[-1][10:] AS lang_raw
  FROM tag_fields WHERE len(p) >= 2
),
tags AS (
  SELECT name, file, kind, lower(regexp_replace(lang_raw, '\\r$', '')) AS lang
  FROM tag_rows WHERE kind IS NOT NULL AND coalesce(strlen(lang_raw), 0) > 0
)"""

NORM_TAGS = """
ntags AS (
  SELECT DISTINCT target_lang, name, file, CASE kind WHEN 't' THEN 'c' ELSE kind END AS kind
  FROM (SELECT *, unnest(CASE WHEN lang IN ('c', 'c++') THEN ['c', 'c++'] ELSE [lang] END) AS target_lang
        FROM tags)
  WHERE (CASE kind WHEN 't' THEN 'c' ELSE kind END) IN ('c', 'd', 'f', 'm')
    AND name NOT IN ('the', 'of')
    AND target_lang IN ({langs})
)"""

STRIP_RE = (
    r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|//[^\n]*"
    r'|"[^"\\]*(?:\\[\s\S][^"\\]*)*"'
    r"|'[^'\\]*(?:\\[\s\S][^'\\]*)*'"
)
STRIP_RE_SQL = STRIP_RE.replace("'", "''")
C_LIKE = "('c', 'c++', 'csharp', 'go', 'java')"

MATCHES = f"""
toks AS (
  SELECT DISTINCT doc_id, lang,
         unnest(regexp_extract_all(CASE WHEN lang IN {C_LIKE}
                  THEN regexp_replace(text, '{STRIP_RE_SQL}', ' ', 'g') ELSE text END, '{ID}')) AS name
  FROM {{docs}}
),
matches AS (
  SELECT t.doc_id, t.lang, n.name, n.kind FROM toks t
    JOIN ntags n ON t.lang = n.target_lang AND t.name = n.name
  UNION
  SELECT d.doc_id, d.lang, n.name, n.kind FROM {{docs}} d
    JOIN ntags n ON d.lang = n.target_lang AND d.source = n.file
)"""

GROUPS = """
kind_groups(kind, grp, prefix, suffix) AS (
  VALUES ('c', 'TagClass', NULL, NULL), ('d', 'TagDefine', NULL, '\\>'),
         ('f', 'TagFunction', NULL, '\\>\\%(\\s*(\\)\\@='), ('m', 'TagMember', '\\%(\\.\\|->\\)\\@<=', NULL)
),
kind_order(kind, pos) AS (VALUES ('c', 0), ('d', 1), ('f', 2), ('m', 3))"""

DOC_LANGS = "['en', 'fr', 'de', 'es']"
DOC_LANG_SET = "'en', 'fr', 'de', 'es'"
C_DOCS = """
cdocs AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'c' WHEN 'fr' THEN 'c++' WHEN 'de' THEN 'java' ELSE lang END AS lang,
         source, text FROM documents
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _tag_pipeline(langs=DOC_LANGS, lang_set=DOC_LANG_SET, docs="documents", extra=()) -> str:
    return _with(
        *extra,
        RAW_TAGS.format(langs=langs),
        PARSED_TAGS,
        NORM_TAGS.format(langs=lang_set),
        MATCHES.format(docs=docs),
    )


ORACLES: dict[str, str] = {}

ORACLES["raw_tags"] = _with(RAW_TAGS.format(langs=DOC_LANGS)) + "\nSELECT line FROM raw_tags"

ORACLES["parse_tags"] = (
    _with(RAW_TAGS.format(langs=DOC_LANGS), PARSED_TAGS) + "\nSELECT name, file, kind, lang FROM tags"
)

ORACLES["token_set"] = f"""
SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{ID}')) AS name FROM documents"""

ORACLES["tag_match"] = _tag_pipeline() + "\nSELECT doc_id, name, kind FROM matches"

ORACLES["kind_pattern"] = (
    _tag_pipeline()
    + ","
    + GROUPS
    + """,
pats AS (
  SELECT doc_id, lang, kind, string_agg(name, '\\|' ORDER BY strlen(name), name) AS pat,
         count(*) AS n
  FROM matches GROUP BY doc_id, lang, kind
),
cmds AS (
  SELECT p.*, g.grp, g.prefix, g.suffix, o.pos,
         '_tw_' || p.lang || '_' || p.kind || '_' || g.grp AS gid
  FROM pats p JOIN kind_groups g USING (kind) JOIN kind_order o USING (kind)
)
SELECT doc_id, kind, CAST(pos AS BIGINT) AS pos, pat, n,
  CASE WHEN prefix IS NULL AND suffix IS NULL
    THEN 'silent! syntax clear ' || gid || ' |  syntax keyword ' || gid || ' ' || replace(pat, '\\|', ' ')
         || ' display | hi def link ' || gid || ' ' || grp
    ELSE 'silent! syntax clear ' || gid || ' | syntax match ' || gid || ' /' || coalesce(prefix, '\\C\\<')
         || '\\%(' || pat || '\\)' || coalesce(suffix, '\\>') || '/ display | hi def link ' || gid || ' ' || grp
  END AS cmd
FROM cmds"""
)

ORACLES["first_of_kind"] = (
    _tag_pipeline()
    + "\nSELECT doc_id, kind, arg_min(name, (strlen(name), name)) AS first_name FROM matches GROUP BY doc_id, kind"
)

ORACLES["match_stats"] = (
    _tag_pipeline()
    + f""",
counts AS (SELECT doc_id, count(*) AS c FROM matches GROUP BY doc_id)
SELECT d.doc_id,
       CAST(len(regexp_extract_all(d.body, '{ID}')) AS BIGINT) AS total_tokens,
       CAST(len(list_distinct(regexp_extract_all(d.body, '{ID}'))) AS BIGINT) AS unique_tokens,
       CAST(coalesce(c.c, 0) AS BIGINT) AS unique_tags
FROM (SELECT doc_id, CASE WHEN lang IN {C_LIKE} THEN regexp_replace(text, '{STRIP_RE_SQL}', ' ', 'g') ELSE text END AS body
      FROM documents) d LEFT JOIN counts c USING (doc_id)"""
)

ORACLES["lang_family"] = (
    _tag_pipeline(
        langs="['c', 'C++', 'java', 'es']",
        lang_set="'c', 'c++', 'java', 'es'",
        docs="cdocs",
        extra=(C_DOCS,),
    )
    + "\nSELECT doc_id, name, kind FROM matches"
)

# ------------------------------------------------------------------ text
CODE_TEXT = """
code AS (
  SELECT doc_id,
         CASE lang WHEN 'en' THEN 'c' WHEN 'fr' THEN 'c++' WHEN 'de' THEN 'java' WHEN 'es' THEN 'python' ELSE lang END AS lang,
         replace(replace(replace(replace(text, '. ', '. /* c. */ '), ', ', ' "s,\\" t" , '),
                 chr(10), ' // eol' || chr(10)), '###', '''#'' /* a ** b */') AS t
  FROM documents
)"""

ORACLES["strip"] = (
    _with(CODE_TEXT)
    + f"""
SELECT doc_id, lang,
       CASE WHEN lang IN {C_LIKE} THEN regexp_replace(t, '{STRIP_RE_SQL}', ' ', 'g') ELSE t END AS stripped
FROM code"""
)

# One character at a time inside a line, one line at a time inside a document.
# Modes: 0 code, 1 comment, 2 string, 3 character literal, 4 region, 9 line comment.
ORACLES["strip_joint"] = r"""
WITH RECURSIVE joint AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'c' WHEN 'fr' THEN 'c++' WHEN 'de' THEN 'java' WHEN 'es' THEN 'python' ELSE lang END AS lang,
    replace(replace(replace(array_to_string(list_transform(
      string_split(regexp_replace(text, '["''\\*/#]', '', 'g'), chr(10)),
      lambda x: CASE substr(x, 1, 1) WHEN 'A' THEN '#if 0' WHEN 'E' THEN '#endif' WHEN 'T' THEN '#ifdef X'
        WHEN 'O' THEN '  #  if 0' WHEN 'I' THEN '#else' ELSE x END), chr(10)),
      ', ', ' /* x' || chr(10) || '#endif' || chr(10) || ' */ '),
      '. ', ' "s\"' || chr(10) || '#if 0' || chr(10) || 't" '),
      '-', ' // e' || chr(10)) AS text
  FROM documents
), code_lines AS (
  SELECT doc_id, lang, unnest(range(len(l))) AS line_no, unnest(l) AS line, len(l) AS n
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM joint WHERE lang IN ('c', 'c++', 'java'))
), cls AS (
  SELECT *, string_split(line, '') AS ch,
    lang <> 'java' AND regexp_matches(line, '^[ \t]*#[ \t]*if 0') AS opens,
    CASE WHEN regexp_matches(line, '^[ \t]*#[ \t]*if') THEN 1
         WHEN regexp_matches(line, '^[ \t]*#[ \t]*endif') THEN -1 ELSE 0 END AS step
  FROM code_lines
), sim(doc_id, line_no, mode, depth, part) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), 0, 0, '' FROM joint WHERE lang IN ('c', 'c++', 'java')
  UNION ALL
  SELECT doc_id, line_no,
    CASE WHEN region THEN (CASE WHEN depth + step = 0 THEN 0 ELSE 4 END) WHEN z.m = 9 THEN 0 ELSE z.m END,
    CASE WHEN region THEN depth + step ELSE 0 END,
    CASE WHEN region THEN '' ELSE z.o || CASE WHEN z.m IN (0, 9) AND line_no + 1 < n THEN chr(10) ELSE '' END END
  FROM (
    SELECT c.doc_id, c.line_no, c.n, c.step, s.depth, s.mode = 4 OR (s.mode = 0 AND c.opens) AS region,
      list_reduce(range(1, len(c.ch) + 1), lambda a, i: {
        'm': CASE WHEN a.s > 0 THEN a.m
             WHEN a.m = 0 THEN CASE WHEN c.ch[i] = '/' AND c.ch[i + 1] = '/' THEN 9 WHEN c.ch[i] = '/' AND c.ch[i + 1] = '*' THEN 1
                               WHEN c.ch[i] = '"' THEN 2 WHEN c.ch[i] = '''' THEN 3 ELSE 0 END
             WHEN a.m = 1 AND c.ch[i] = '*' AND c.ch[i + 1] = '/' THEN 0
             WHEN a.m = 2 AND c.ch[i] = '"' THEN 0 WHEN a.m = 3 AND c.ch[i] = '''' THEN 0 ELSE a.m END,
        's': CASE WHEN a.s > 0 THEN a.s - 1
             WHEN a.m = 0 AND c.ch[i] = '/' AND c.ch[i + 1] = '*' THEN 1
             WHEN a.m = 1 AND c.ch[i] = '*' AND c.ch[i + 1] = '/' THEN 1
             WHEN a.m IN (2, 3) AND c.ch[i] = '\' THEN 1 ELSE 0 END,
        'o': CASE WHEN a.s > 0 OR a.m <> 0 THEN a.o
             WHEN (c.ch[i] = '/' AND c.ch[i + 1] IN ('/', '*')) OR c.ch[i] IN ('"', '''') THEN a.o || ' '
             ELSE a.o || c.ch[i] END
      }, {'m': s.mode, 's': 0, 'o': ''}) AS z
    FROM sim s JOIN cls c ON c.doc_id = s.doc_id AND c.line_no = s.line_no + 1
  )
)
SELECT doc_id, lang, coalesce(string_agg(part, '' ORDER BY line_no), '') AS stripped
FROM sim JOIN joint USING (doc_id) GROUP BY doc_id, lang
UNION ALL
SELECT doc_id, lang, text FROM joint WHERE lang NOT IN ('c', 'c++', 'java')"""

ORACLES["collapse_blanks"] = r"""
SELECT doc_id,
       regexp_replace(replace(replace(text, ', ', ',  ' || chr(9) || ' '), chr(10), chr(10) || '  '),
                      '([^ \t\n])([ \t])[ \t]+', '\1\2', 'g') AS collapsed
FROM documents"""

ORACLES["vim_tokens"] = """
WITH v AS (
  SELECT doc_id, regexp_extract_all(replace(text, ' ', ':'), '[A-Za-z_][A-Za-z0-9_:]*') AS toks FROM documents
)
SELECT DISTINCT doc_id,
       unnest(list_concat(toks, list_transform(list_filter(toks, lambda x: strpos(x, ':') > 0),
                                               lambda x: substr(x, strpos(x, ':') + 1)))) AS name
FROM v"""

DOC_LINES = """
doc_lines AS (
  SELECT doc_id, lang, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)
)"""

IF0_LINES = """
if0_lines AS (
  SELECT doc_id,
         CASE lang WHEN 'en' THEN 'c' WHEN 'fr' THEN 'c++' WHEN 'de' THEN 'java' WHEN 'es' THEN 'python' ELSE lang END AS lang,
         line_no,
         CASE substr(line, 1, 1) WHEN 'A' THEN '#if 0' WHEN 'E' THEN '#endif' WHEN 'T' THEN '#ifdef X'
              WHEN 'O' THEN '  #  if 0' WHEN 'I' THEN '#else' ELSE line END AS line
  FROM doc_lines
)"""

# Independent oracle: a line-by-line simulation of the depth counter.
ORACLES["if0_strip"] = (
    "WITH RECURSIVE "
    + ",".join([DOC_LINES, IF0_LINES])
    + r""",
cls AS (
  SELECT *, regexp_matches(line, '^[ \t]*#') AS is_hash,
         regexp_replace(line, '^[ \t]*#[ \t]*', '') AS rest,
         lang IN ('c', 'c++') AS is_c
  FROM if0_lines
),
sim(doc_id, line_no, depth, keep) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), 0, true FROM documents
  UNION ALL
  SELECT c.doc_id, c.line_no,
         CASE WHEN s.depth > 0 THEN
                s.depth + CASE WHEN c.is_hash AND starts_with(c.rest, 'if') THEN 1
                               WHEN c.is_hash AND starts_with(c.rest, 'endif') THEN -1 ELSE 0 END
              WHEN c.is_c AND c.is_hash AND starts_with(c.rest, 'if 0') THEN 1
              ELSE 0 END,
         s.depth = 0 AND NOT (c.is_c AND c.is_hash AND starts_with(c.rest, 'if 0'))
  FROM sim s JOIN cls c ON c.doc_id = s.doc_id AND c.line_no = s.line_no + 1
)
SELECT c.doc_id, c.line_no, c.line FROM sim s JOIN cls c USING (doc_id, line_no) WHERE s.keep"""
)

ORACLES["buffer_lines"] = "SELECT doc_id, text || chr(10) AS body FROM documents"

ORACLES["line_splice"] = """
WITH d AS (SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS f, CAST(doc_id % 4 + n_chars % 3 AS INTEGER) AS t,
                  string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, array_to_string(list_concat(list_concat(l[1:f], ['x', 'y']), l[t + 1:]), chr(10)) AS edited FROM d"""

# The whole pipeline on code: a line-by-line simulation of the #if 0 counter, then
# comments and literals, then tokens and the join.
ORACLES["source_match"] = (
    "WITH RECURSIVE "
    + ",".join(
        [
            C_DOCS,
            """
code_lines AS (
  SELECT doc_id, lang, line_no,
         CASE substr(line, 1, 1) WHEN 'A' THEN '#if 0' WHEN 'E' THEN '#endif' WHEN 'T' THEN '#ifdef X'
              WHEN 'O' THEN '  #  if 0' WHEN 'I' THEN '#else' ELSE line END AS line
  FROM (SELECT doc_id, lang, unnest(range(len(l))) AS line_no, unnest(l) AS line
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM cdocs))
),
cls AS (
  SELECT *, regexp_matches(line, '^[ \\t]*#') AS is_hash, regexp_replace(line, '^[ \\t]*#[ \\t]*', '') AS rest
  FROM code_lines
),
sim(doc_id, line_no, depth, keep) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), 0, true FROM cdocs
  UNION ALL
  SELECT c.doc_id, c.line_no,
         CASE WHEN s.depth > 0 THEN
                s.depth + CASE WHEN c.is_hash AND starts_with(c.rest, 'if') THEN 1
                               WHEN c.is_hash AND starts_with(c.rest, 'endif') THEN -1 ELSE 0 END
              WHEN c.lang IN ('c', 'c++') AND c.is_hash AND starts_with(c.rest, 'if 0') THEN 1
              ELSE 0 END,
         s.depth = 0 AND NOT (c.lang IN ('c', 'c++') AND c.is_hash AND starts_with(c.rest, 'if 0'))
  FROM sim s JOIN cls c ON c.doc_id = s.doc_id AND c.line_no = s.line_no + 1
),
sources AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(replace(k.body, ', ', ' /* x, y */ '), '') AS text
  FROM cdocs d LEFT JOIN (
    SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.line_no) AS body
    FROM sim s JOIN cls c USING (doc_id, line_no) WHERE s.keep GROUP BY c.doc_id
  ) k USING (doc_id)
)""",
            RAW_TAGS.format(langs="['c', 'C++', 'java', 'es']"),
            PARSED_TAGS,
            NORM_TAGS.format(langs="'c', 'c++', 'java', 'es'"),
            MATCHES.format(docs="sources"),
        ]
    )
    + "\nSELECT doc_id, name, kind FROM matches"
)

ORACLES["command_editor_name"] = (
    _tag_pipeline(
        langs="['c', 'C++', 'java', 'es']", lang_set="'c', 'c++', 'java', 'es'", docs="cdocs", extra=(C_DOCS,)
    )
    + """,
pats AS (
  SELECT doc_id, kind, string_agg(name, '\\|' ORDER BY strlen(name), name) AS pat,
         string_agg(name, ' ' ORDER BY strlen(name), name) AS words, count(*) AS n,
         '_tw_' || any_value(CASE lang WHEN 'c++' THEN 'cpp' ELSE lang END) || '_' || kind || '_'
         || CASE kind WHEN 'd' THEN 'TagDefine' ELSE '' END AS gid,
         CASE kind WHEN 'd' THEN 'TagDefine' ELSE '' END AS grp
  FROM matches GROUP BY doc_id, kind
)
SELECT doc_id, kind, CAST(strpos('cdfm', kind) - 1 AS BIGINT) AS pos, pat, n,
       'silent! syntax clear ' || gid || ' |  syntax keyword ' || gid || ' ' || words
       || ' display | hi def link ' || gid || ' ' || grp AS cmd
FROM pats"""
)

ORACLES["include_extract"] = (
    _with(DOC_LINES)
    + r""",
inc_lines AS (
  SELECT doc_id, line_no,
         CASE line_no % 5
           WHEN 0 THEN '#include "' || w || '.h"'
           WHEN 1 THEN '#  include   "' || w || '/x.h" // c'
           WHEN 2 THEN ' #include "' || w || '.h"'
           WHEN 3 THEN '#include <' || w || '.h>'
           ELSE '#include ""' END AS line
  FROM (SELECT *, lower(regexp_extract(line, '[A-Za-z_][A-Za-z0-9_]*', 0)) AS w FROM doc_lines)
),
ext AS (
  SELECT doc_id, line_no,
         coalesce(nullif(regexp_extract(line, '^#[ \t]*include[ \t]*(?:"([^"]*)"|<([^>]*)>)', 1), ''),
                  nullif(regexp_extract(line, '^#[ \t]*include[ \t]*(?:"([^"]*)"|<([^>]*)>)', 2), '')) AS inc
  FROM inc_lines
)
SELECT doc_id, line_no, inc FROM ext WHERE inc IS NOT NULL"""
)

ORACLES["line_dump"] = (
    _with(DOC_LINES) + "\nSELECT doc_id, line_no, CAST(line_no AS VARCHAR) || ':' || chr(9) || line AS entry FROM doc_lines"
)

ORACLES["lines_range"] = """
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, l[-1] AS last_line, l[4] AS nth_line,
       array_to_string(l[3:5], chr(10)) AS range_text
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""

ORACLES["reconcile"] = """
SELECT doc_id, n_chars AS recorded, CAST(length(text) AS BIGINT) AS counted_chars,
       CAST(strlen(text) AS BIGINT) AS counted_bytes,
       CAST(len(string_split(text, chr(10))) AS BIGINT) AS counted_lines,
       n_chars = length(text) AS ok
FROM documents"""

# ------------------------------------------------------------------ paths
# Independent oracle: a stack machine over the segments, one step per row.
CLEAN = """
seg AS (SELECT page_id, starts_with(raw, '/') AS rooted, string_split(raw, '/') AS parts FROM raw_paths),
steps(page_id, i, stack) AS (
  SELECT page_id, 0, []::VARCHAR[] FROM seg
  UNION ALL
  SELECT s.page_id, t.i + 1,
         CASE WHEN s.parts[t.i + 1] IN ('', '.') THEN t.stack
              WHEN s.parts[t.i + 1] <> '..' THEN list_append(t.stack, s.parts[t.i + 1])
              WHEN len(t.stack) > 0 AND t.stack[-1] <> '..' THEN t.stack[:-2]
              WHEN s.rooted THEN t.stack
              ELSE list_append(t.stack, '..') END
  FROM steps t JOIN seg s USING (page_id) WHERE t.i < len(s.parts)
),
cleaned AS (
  SELECT t.page_id,
         CASE WHEN s.rooted THEN '/' || array_to_string(t.stack, '/')
              WHEN len(t.stack) = 0 THEN '.' ELSE array_to_string(t.stack, '/') END AS clean
  FROM steps t JOIN seg s USING (page_id) WHERE t.i = len(s.parts)
)"""

_DIR = "(CASE WHEN NOT contains(path, '/') THEN '.' WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END)"
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_PAGE_PATHS = "p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages)"

ORACLES["path_parts"] = f"""
WITH RECURSIVE {_PAGE_PATHS},
raw_paths AS (SELECT page_id, concat_ws('/', {_DIR}, '.', 'x', '..', {_BASE}) AS raw FROM p),{CLEAN}
SELECT page_id, path, {_DIR} AS dir, {_BASE} AS base, clean AS joined
FROM p JOIN cleaned USING (page_id)"""

ORACLES["path_clean_deep"] = f"""
WITH RECURSIVE {_PAGE_PATHS},
raw_paths AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END || path || '/a/b/./c/d//e/f/g/h/i/j'
                  || repeat('/..', 10 + page_id % 4) || '/./z//y/' AS raw FROM p
),{CLEAN}
SELECT page_id, clean FROM cleaned"""

ORACLES["cache_key"] = r"""
SELECT page_id, regexp_replace(url, '[/:\\]', '__', 'g') || '.html.tags.gz' AS cache_key FROM pages"""

# ------------------------------------------------------------------ events
ORACLES["tick_gate"] = """
WITH e AS (SELECT event_id, ts, user_id, event_type,
                  TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
g AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pk FROM e)
SELECT event_id, user_id, k FROM g WHERE event_type = 'signup' OR k <> coalesce(pk, 0)"""

ORACLES["active_switch"] = """
WITH g AS (SELECT *, lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pu FROM events)
SELECT event_id, event_type, user_id FROM g WHERE pu IS NULL OR pu <> user_id"""

ORACLES["unique_ordered"] = """
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
           FROM events WHERE event_type IS NOT NULL AND event_type <> ''),
f AS (SELECT user_id, event_type, min(rn) AS first_rn FROM r GROUP BY 1, 2)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_rn) AS pos FROM f"""

ORACLES["keyword_rollup"] = """
WITH k AS (SELECT user_id, string_agg(event_type, ' ' ORDER BY event_type DESC) AS keywords
           FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL) GROUP BY user_id)
SELECT user_id, keywords,
       'syntax clear grp_' || user_id || ' | syntax keyword grp_' || user_id || ' ' || keywords
       || '  | hi! link grp_' || user_id || ' Identifier' AS cmd
FROM k"""

EDITOR_EVENTS = """
ee AS (
  SELECT event_id, user_id,
         CASE event_type WHEN 'view' THEN 'nvim_buf_lines_event' WHEN 'click' THEN 'nvim_buf_changedtick_event'
              WHEN 'purchase' THEN 'nvim_buf_detach_event' WHEN 'signup' THEN 'vim_event_update'
              ELSE event_type END AS name,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS tick
  FROM events
)"""

ORACLES["event_route"] = (
    _with(EDITOR_EVENTS)
    + """,
r AS (
  SELECT *, CASE name WHEN 'nvim_buf_lines_event' THEN 'lines' WHEN 'nvim_buf_changedtick_event' THEN 'changedtick'
                      WHEN 'nvim_buf_detach_event' THEN 'detach' WHEN 'vim_event_update' THEN 'update'
                      ELSE 'quarantine' END AS route
  FROM ee
),
c AS (SELECT *, CASE WHEN route = 'update' THEN substr('ABCDEF', CAST(tick % 6 + 1 AS INTEGER), 1) END AS code FROM r)
SELECT event_id, user_id, name, route, code,
       CASE code WHEN 'A' THEN 'switch' WHEN 'B' THEN 'refresh' WHEN 'C' THEN 'stop' WHEN 'D' THEN 'switch'
                 WHEN 'E' THEN 'clear' WHEN 'F' THEN 'refresh' END AS action,
       coalesce(code = 'F', false) AS force
FROM c"""
)

ORACLES["coerce_props"] = """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CASE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) WHEN 0 THEN false WHEN 1 THEN true END AS k_bool,
       json_extract_string(props, '$.k') AS k_str,
       array_to_string(json_keys(props), ',') AS keys
FROM events"""

ORACLES["coerce_lists"] = """
SELECT event_id, event_type || '|' || user_id AS strings,
       CASE WHEN event_id % 3 <> 0 THEN (event_id % 7) || '|0|' || user_id END AS ints, true AS not_a_list
FROM events"""

ORACLES["coerce_maps"] = """
SELECT event_id, CAST(user_id AS VARCHAR) AS n_text, 'x|' || event_type AS a_list, CAST(user_id AS VARCHAR) AS s_list,
       true AS n_not_a_list, 'z' AS v,
       CASE WHEN event_type[1] < 'v' THEN event_type[1] || 'v' WHEN event_type[1] > 'v' THEN 'v' || event_type[1] ELSE 'v' END AS letters
FROM events"""

ORACLES["keyword_listing"] = """
WITH w AS (
  SELECT doc_id, source, ltrim(line, ' ' || chr(9) || chr(13)) AS word, ord
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord
        FROM documents WHERE lang NOT IN ('fr', 'de'))
),
k AS (
  SELECT doc_id, any_value(source) AS source, coalesce(string_agg(DISTINCT word, ' ' ORDER BY word DESC) FILTER (word <> ''), '') AS words
  FROM (SELECT doc_id, source, CASE WHEN ord = 0 THEN line0 ELSE word END AS word
        FROM (SELECT w.*, string_split(d.text, chr(10))[1] AS line0 FROM w JOIN documents d USING (doc_id)))
  GROUP BY doc_id
),
c AS (
  SELECT doc_id, 'syntax clear g' || doc_id || ' | syntax keyword g' || doc_id || ' ' || words || '  | hi! link g' || doc_id
         || ' ' || source AS cmd FROM k
)
SELECT doc_id // 5 AS owner, string_agg(cmd, ' | ' ORDER BY doc_id) AS cmds FROM c GROUP BY 1"""

# ------------------------------------------------------------------ edits
ORACLES["edit_replay"] = """
WITH RECURSIVE e AS (
  SELECT conv_id AS buf, turn AS ctick,
         CASE WHEN turn = 0 THEN 0 ELSE turn % 3 END AS f,
         CASE WHEN turn = 0 THEN 1 ELSE turn % 3 + 1 END AS l,
         string_split(text, chr(10)) AS ls,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
  FROM conversations
),
r(buf, rn, ctick, lines, init) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), [''], false FROM conversations
  UNION ALL
  SELECT e.buf, e.rn, e.ctick,
         CASE WHEN len(r.lines) <= 1 AND e.f = 0 AND len(e.ls) = 1 AND e.ls[1] = '' THEN r.lines
              WHEN len(list_concat(list_concat(r.lines[1:e.f], e.ls), r.lines[greatest(e.l, e.f) + 1:])) = 0 THEN ['']
              ELSE list_concat(list_concat(r.lines[1:e.f], e.ls), r.lines[greatest(e.l, e.f) + 1:]) END,
         r.init OR NOT (len(r.lines) <= 1 AND e.f = 0 AND len(e.ls) = 1 AND e.ls[1] = '')
  FROM r JOIN e ON e.buf = r.buf AND e.rn = r.rn + 1
)
SELECT buf, ctick, CAST(len(lines) AS BIGINT) AS n_lines, array_to_string(lines, chr(10)) AS text,
       init AS initialized
FROM r WHERE (buf, rn) IN (SELECT (buf, max(rn)) FROM e GROUP BY buf)"""

# ------------------------------------------------------------------ includes
INCLUDE_REFS = """
refs AS (
  SELECT doc_id, 'd' || (doc_id % 7) AS own_dir, 'f' || (n_chars % 40) AS inc,
         list_distinct(['d' || (doc_id % 2 * 7 + 1), 'd' || (doc_id % 7)]) AS search_dirs
  FROM documents
),
manifest AS (SELECT DISTINCT 'd' || (doc_id % 9) AS dir, 'f' || (doc_id % 31) AS file FROM documents),
own AS (
  SELECT r.doc_id, r.own_dir, r.inc, m.dir || '/' || m.file AS path
  FROM refs r JOIN manifest m ON m.dir = r.own_dir AND m.file = r.inc
),
resolved AS (
  SELECT doc_id, path FROM own
  UNION
  SELECT x.doc_id, m.dir || '/' || m.file
  FROM (SELECT doc_id, inc, unnest(search_dirs) AS dir FROM refs r
        WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = r.doc_id AND o.own_dir = r.own_dir AND o.inc = r.inc)) x
  JOIN manifest m ON m.dir = x.dir AND m.file = x.inc
)"""

ORACLES["include_resolve"] = _with(INCLUDE_REFS) + "\nSELECT doc_id, path FROM resolved"

ORACLES["headers_sorted"] = (
    _with(INCLUDE_REFS) + "\nSELECT doc_id, string_agg(path, ',' ORDER BY path) AS headers FROM resolved GROUP BY doc_id"
)

ORACLES["include_closure"] = """
WITH RECURSIVE n AS (SELECT count(*) AS c FROM documents),
edges AS (
  SELECT doc_id AS src, (doc_id * 2 + 1) % (SELECT c FROM n) AS dst FROM documents
  UNION
  SELECT doc_id, n_chars % (SELECT c FROM n) FROM documents
),
walk(root, node, lvl) AS (
  SELECT doc_id, doc_id, 0 FROM documents
  UNION
  SELECT w.root, e.dst, w.lvl + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.lvl < 9
)
SELECT root, node, CAST(min(lvl) AS BIGINT) AS depth FROM walk WHERE lvl >= 1 GROUP BY root, node"""

ORACLES["find_file"] = """
WITH m AS (SELECT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages),
b AS (
  SELECT regexp_extract(path, '([^/]*)$', 1) AS name,
         arg_min(path, (length(path) - length(replace(path, '/', '')), path)) AS path
  FROM m GROUP BY 1
)
SELECT d.doc_id, CAST(d.n_chars % 1000 AS VARCHAR) AS name, b.path
FROM documents d LEFT JOIN b ON b.name = CAST(d.n_chars % 1000 AS VARCHAR)"""

# ------------------------------------------------------------------ projects
ORACLES["longest_prefix"] = """
WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*)/[^/]*$', 1) AS dir FROM pages),
roots AS (
  SELECT DISTINCT r FROM (
    SELECT regexp_extract(url, '^[a-z]+://[^/]+', 0) AS r FROM pages WHERE contains(url, '?')
    UNION ALL
    SELECT regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+', 0) FROM pages WHERE contains(url, '#'))
  WHERE length(r) > 0
)
SELECT page_id, dir, coalesce(arg_max(r, length(r)), dir) AS root
FROM p LEFT JOIN roots ON starts_with(p.dir, roots.r)
GROUP BY page_id, dir"""

ORACLES["longest_prefix_rows"] = ORACLES["longest_prefix"].replace("SELECT page_id, dir, coalesce", "SELECT dir, coalesce")

BUFFERS = """
buffers AS (
  SELECT doc_id,
         CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'cpp' WHEN 'de' THEN 'vim' WHEN 'es' THEN 'es' ELSE lang END AS ft,
         '/w/' || lang || '/' || source || '/f' || doc_id || '.txt' AS filename,
         '/w/' || lang || '/' || source AS dir
  FROM documents
),
filetypes(ft_id, ft) AS (VALUES (0, 'NONE'), (1, 'c'), (2, 'cpp'), (3, 'cs'), (4, 'go'), (5, 'java'),
  (6, 'javascript'), (7, 'lisp'), (8, 'perl'), (9, 'php'), (10, 'python'), (11, 'ruby'), (12, 'rust'),
  (13, 'sh'), (14, 'vim'), (15, 'zsh')),
admitted AS (
  SELECT b.*, CAST(f.ft_id AS BIGINT) AS ft_id,
         CASE WHEN b.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'rejected_id'
              WHEN f.ft_id IS NULL THEN 'unknown_filetype'
              WHEN b.ft IN ('vim') THEN 'ignored_filetype'
              ELSE 'admitted' END AS status
  FROM buffers b LEFT JOIN filetypes f USING (ft)
),
proots(root) AS (VALUES ('/w/en'), ('/w/fr'), ('/w/en/src1'), ('/w/es/src2')),
norecurse(root) AS (VALUES ('/w/en/src1'), ('/w/es/src2')),
units0 AS (
  SELECT a.doc_id, a.ft, a.filename, a.dir, coalesce(arg_max(p.root, length(p.root)), a.dir) AS root
  FROM admitted a LEFT JOIN proots p ON starts_with(a.dir, p.root)
  WHERE a.status = 'admitted'
  GROUP BY a.doc_id, a.ft, a.filename, a.dir
),
units AS (
  SELECT *, root NOT IN (SELECT root FROM norecurse) AS recurse, ft IN ('c', 'cpp') AS is_c,
         CASE WHEN root IN (SELECT root FROM norecurse) OR ft IN ('c', 'cpp') THEN filename ELSE root END AS unit
  FROM units0
)"""

ORACLES["find_buffers"] = (
    _with(BUFFERS)
    + "\nSELECT doc_id, ft, filename, dir FROM buffers WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
)
ORACLES["admit_buffers"] = _with(BUFFERS) + "\nSELECT doc_id, ft, ft_id, status FROM admitted"
ORACLES["project_units"] = _with(BUFFERS) + "\nSELECT doc_id, ft, root, recurse, is_c, unit FROM units"
ORACLES["project_refs"] = _with(BUFFERS) + "\nSELECT ft, unit, count(*) AS refs FROM units GROUP BY ft, unit"
SOURCE_FILES = r"""
src_lines AS (
  SELECT doc_id, lang, source, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)
),
src_targets AS (
  SELECT *, (doc_id * 2 + length(line)) % 500 AS far, (doc_id + 3 * length(line)) % 600 AS own, (doc_id * 7 + length(line)) % 400 AS other
  FROM src_lines
),
src_incs AS (
  SELECT DISTINCT doc_id, lang, source, CASE line_no % 5 WHEN 0 THEN 'h' || (far % 3) || '/f' || far || '.h'
    WHEN 1 THEN 'f' || own || '.h' ELSE '../h' || (other % 3) || '/f' || other || '.h' END AS inc
  FROM src_targets WHERE line_no % 5 IN (0, 1, 3)
),
hdr AS (SELECT doc_id, '/w/fr/h' || (doc_id % 3) || '/f' || doc_id || '.h' AS path, '/w/fr/h' || (doc_id % 3) AS dir FROM documents),
bufs AS (SELECT doc_id, '/w/fr/' || source || '/f' || doc_id || '.txt' AS path, '/w/fr/' || source AS dir FROM documents WHERE lang = 'fr'),
all_files AS (SELECT * FROM hdr UNION ALL SELECT * FROM bufs),
all_incs AS (
  SELECT f.path AS src, f.dir, i.inc, regexp_replace(f.dir || '/' || i.inc, '/[^/]+/[.][.]/', '/') AS near
  FROM all_files f JOIN src_incs i USING (doc_id)
)"""
ORACLES["include_edges"] = (
    _with(SOURCE_FILES)
    + """
SELECT src, near AS dst FROM all_incs WHERE near IN (SELECT path FROM all_files)
UNION
SELECT src, regexp_replace('/w/fr/' || inc, '/[^/]+/[.][.]/', '/') FROM all_incs
WHERE near NOT IN (SELECT path FROM all_files)
  AND regexp_replace('/w/fr/' || inc, '/[^/]+/[.][.]/', '/') IN (SELECT path FROM all_files)"""
)
# A walk of (buffer, file) pairs; the search directories are the buffer's.
HEADER_WALK = SOURCE_FILES + """,
c_units AS (SELECT u.doc_id, u.filename, u.dir, u.root FROM units u WHERE is_c),
walk(doc_id, root, dir, path, lvl) AS (
  SELECT doc_id, root, dir, filename, 0 FROM c_units
  UNION
  SELECT doc_id, root, dir, unnest(CASE WHEN near IN (SELECT path FROM all_files) THEN [near]
    ELSE list_filter([CASE WHEN at_root IN (SELECT path FROM all_files) THEN at_root END,
                      CASE WHEN at_dir IN (SELECT path FROM all_files) THEN at_dir END], lambda x: x IS NOT NULL) END), lvl + 1
  FROM (SELECT w.doc_id, w.root, w.dir, w.lvl, i.near,
          regexp_replace(w.root || '/' || i.inc, '/[^/]+/[.][.]/', '/') AS at_root,
          regexp_replace(w.dir || '/' || i.inc, '/[^/]+/[.][.]/', '/') AS at_dir
        FROM walk w JOIN all_incs i ON i.src = w.path WHERE w.lvl < 9)
)"""
ORACLES["header_closure"] = (
    _with(BUFFERS, HEADER_WALK).replace("WITH", "WITH RECURSIVE", 1)
    + "\nSELECT doc_id, path, CAST(min(lvl) AS BIGINT) AS depth FROM walk WHERE lvl > 0 GROUP BY doc_id, path"
)
ORACLES["scan_set"] = (
    _with(BUFFERS, HEADER_WALK).replace("WITH", "WITH RECURSIVE", 1)
    + """
SELECT ft, unit, filename AS member FROM units WHERE is_c OR NOT recurse
UNION
SELECT u.ft, u.unit, b.filename FROM units u JOIN buffers b ON b.ft = u.ft AND starts_with(b.filename, u.unit || '/')
WHERE u.recurse AND NOT u.is_c
UNION
SELECT u.ft, u.unit, w.path FROM units u JOIN walk w USING (doc_id) WHERE w.lvl > 0"""
)
ORACLES["cache_or_build"] = (
    _with(BUFFERS)
    + r"""
SELECT doc_id, unit, regexp_replace(unit, '[/:\\]', '__', 'g') || '.' || ft || '.tags.gz' AS cache_key,
       CASE WHEN doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
            THEN 'stored' ELSE 'built' END AS status
FROM units"""
)

# ------------------------------------------------------------------ incremental
AFTER_DOCS = """
after_docs AS (
  SELECT doc_id, lang, source,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN replace(text, 'e', 'a') ELSE text END AS text
  FROM documents
)"""
ORACLES["incremental_match"] = (
    _tag_pipeline(docs="after_docs", extra=(AFTER_DOCS,)) + "\nSELECT doc_id, name, kind FROM matches"
)

# A full recompute of the second snapshot against the second index.
ORACLES["index_delta_match"] = (
    _with(
        AFTER_DOCS,
        """
open_docs AS (
  SELECT * FROM after_docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
)""",
        RAW_TAGS.format(langs=DOC_LANGS),
        PARSED_TAGS,
        NORM_TAGS.format(langs=DOC_LANG_SET).replace("ntags AS", "old_tags AS"),
        """
ntags AS (
  SELECT DISTINCT target_lang, file, kind,
         CASE WHEN length(name) % 5 = 0 THEN left(name, length(name) - 1) ELSE name END AS name
  FROM old_tags
)""",
        MATCHES.format(docs="open_docs"),
    )
    + "\nSELECT doc_id, name, kind FROM matches"
)

# Exact counts; both error bounds hold in every group.
ORACLES["token_sketch"] = f"""
WITH t AS (SELECT lang, source, unnest(regexp_extract_all(text, '{ID}')) AS name FROM documents)
SELECT lang, source, count(*) AS n_tokens, count(DISTINCT name) AS unique_tokens,
       true AS unique_within, true AS top_within
FROM t GROUP BY lang, source"""
