"""Fixed values that must equal the original tool's for equal results.

They are stated once, plainly and in their natural order.
"""

# --- fixed values: filetype table (id, editor name, indexer language name) ---
FILETYPES = [
    (0, "NONE", "NONE"),
    (1, "c", "c"),
    (2, "cpp", "c++"),
    (3, "cs", "csharp"),
    (4, "go", "go"),
    (5, "java", "java"),
    (6, "javascript", "javascript"),
    (7, "lisp", "lisp"),
    (8, "perl", "perl"),
    (9, "php", "php"),
    (10, "python", "python"),
    (11, "ruby", "ruby"),
    (12, "rust", "rust"),
    (13, "sh", "sh"),
    (14, "vim", "vim"),
    (15, "zsh", "zsh"),
]

# --- fixed values: languages whose comments and literals are stripped ---
C_LIKE_LANGS = ["c", "c++", "csharp", "go", "java"]
# Languages that share one tag namespace (a C project accepts both).
C_FAMILY = ["c", "c++"]

# --- fixed values: index line format ---
PSEUDO_TAG_PREFIX = "!"
LANGUAGE_FIELD = "language:"

# --- fixed values: highlight command formats ---
DEFAULT_PREFIX = "\\C\\<"
DEFAULT_SUFFIX = "\\>"
PATTERN_SEPARATOR = "\\|"
MATCH_COMMAND = (
    "silent! syntax clear {gid} | syntax match {gid} /{prefix}\\%({pat}\\){suffix}/ display"
    " | hi def link {gid} {group}"
)
KEYWORD_COMMAND = (
    "silent! syntax clear {gid} |  syntax keyword {gid} {words} display | hi def link {gid} {group}"
)
RESTORE_COMMAND = "syntax clear {group} | syntax keyword {group} {words}  | hi! link {group} {link}"

# Syntax group ids are "<GROUP_PREFIX>_<editor name>_<kind>_<group>"; the
# prefix only namespaces this package's groups in the editor.
GROUP_PREFIX = "_tw"

# --- fixed values: preprocessor directives (text after "#" and blanks) ---
IF_DIRECTIVE = "if"
ENDIF_DIRECTIVE = "endif"
IF0_DIRECTIVE = "if 0"
INCLUDE_DIRECTIVE = "include"

# --- fixed values: include search ---
MAX_HEADER_SEARCH_LEVEL = 8

# --- fixed values: index store naming ---
CACHE_SUFFIXES = {"none": ".tags", "gzip": ".tags.gz", "xz": ".tags.xz"}

# --- fixed values: editor event names and their kinds ---
EVENT_NAMES = [
    ("nvim_buf_lines_event", "lines"),
    ("nvim_buf_changedtick_event", "changedtick"),
    ("nvim_buf_detach_event", "detach"),
    ("vim_event_update", "update"),
]
# --- fixed values: one-letter update codes ---
UPDATE_CODES = [
    ("A", "switch"),
    ("B", "refresh"),
    ("C", "stop"),
    ("D", "switch"),
    ("E", "clear"),
    ("F", "refresh"),
]
FORCE_CODE = "F"
