"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import table, tokenizer_path
from tagweave.llm.decontaminate import contained_items
from tagweave.llm.exact_dedup import exact_dedup
from tagweave.llm.html_extract import extract_pages
from tagweave.llm.jaccard_join import jaccard_join
from tagweave.llm.language_id import language_id
from tagweave.llm.lm_score import lm_scores
from tagweave.llm.merkle import merkle_manifest, tampered_counts
from tagweave.llm.packing import pack_documents
from tagweave.llm.sharding import shard_documents
from tagweave.llm.spelling import spelling_variants
from tagweave.llm.substring_dedup import drop_repeated_passages
from tagweave.llm.suffix_dedup import drop_repeated_strings
from tagweave.llm.toxicity import toxicity


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def _span_sum(spans: str) -> Column:
    """Items in an array of ``(start, end)`` ranges."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_words",
        _span_sum("removed").alias("n_removed"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_strings(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        _span_sum("removed").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered=tampered_counts())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sharding": op9_sharding,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_language_id": op13_language_id,
}

#: The 256 remainders of CRC-32, by its rule.
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i))"""


def _crc32(data: str, table: str = "crc_table") -> str:
    """SQL of the unsigned CRC-32 of a list of bytes."""
    step = f"lambda c, b: xor(c >> 8, {table}[(xor(c, b::BIGINT) & 255) + 1])"
    return f"xor(list_reduce({data}, {step}, 4294967295::BIGINT), 4294967295)"


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), iw AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark
), ish AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
    lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s
  FROM iw WHERE len(w) > 0
), q AS (SELECT item_id, count(*) AS n FROM ish GROUP BY item_id),
widths AS (SELECT DISTINCT least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
dsh AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM dw, widths WHERE len(w) >= k
)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item,
       count(*) / any_value(n)::DOUBLE AS containment
FROM dsh JOIN ish USING (s) JOIN q USING (item_id)
GROUP BY doc_id, item_id
HAVING 5 * count(*) >= 4 * any_value(n)
""",
    "op4_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM n WINDOW g AS (PARTITION BY h)
""",
    "op5_jaccard_join": r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
    lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s
  FROM dw WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n
  HAVING 5 * count(*) >= 4 * (p.n + q.n - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
), class AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x),
degree AS (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x)
SELECT c.doc_id, c.class_id, coalesce(d.n_links, 0) AS n_links
FROM class c LEFT JOIN degree d USING (doc_id)
""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field('text')}) AS leaf,
    sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('(n_chars + 1)')} || {_field('text')}) AS tampered,
    {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))")} % 7 = 0 AS hit
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), low(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, lvl, pos // 2, h, n FROM (
    SELECT tree, lvl + 1 AS lvl, pos, (n + 1) // 2 AS n,
      sha256(h || coalesce(lead(h) OVER (PARTITION BY tree ORDER BY pos), '')) AS h
    FROM low WHERE n > 1) WHERE pos % 2 = 0
), high(tree, lvl, pos, h, n) AS (
  SELECT -1::BIGINT, 0, tree, h, (SELECT count(DISTINCT tree) FROM placed) FROM low WHERE n = 1
  UNION ALL
  SELECT tree, lvl, pos // 2, h, n FROM (
    SELECT tree, lvl + 1 AS lvl, pos, (n + 1) // 2 AS n,
      sha256(h || coalesce(lead(h) OVER (PARTITION BY tree ORDER BY pos), '')) AS h
    FROM high WHERE n > 1) WHERE pos % 2 = 0
), node AS (SELECT * FROM low UNION ALL SELECT * FROM high),
climb(doc_id, leaf, start, tree, lvl, pos, f, proof) AS (
  SELECT doc_id, leaf, tree, tree, 0, pos, CASE WHEN hit THEN coalesce(tampered, leaf) ELSE leaf END, '' FROM placed
  UNION ALL
  SELECT c.doc_id, c.leaf, c.start,
    CASE WHEN x.n = 1 THEN -1 ELSE c.tree END,
    CASE WHEN x.n = 1 THEN 0 ELSE c.lvl + 1 END,
    CASE WHEN x.n = 1 THEN c.tree ELSE c.pos // 2 END,
    CASE WHEN x.n = 1 THEN c.f WHEN s.h IS NULL THEN sha256(c.f)
         WHEN c.pos % 2 = 1 THEN sha256(s.h || c.f) ELSE sha256(c.f || s.h) END,
    CASE WHEN x.n = 1 THEN c.proof ELSE c.proof || coalesce(s.h, '') END
  FROM climb c JOIN node x ON x.tree = c.tree AND x.lvl = c.lvl AND x.pos = c.pos
  LEFT JOIN node s ON s.tree = c.tree AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1)
  WHERE NOT (c.tree = -1 AND x.n = 1)
)
SELECT c.doc_id, c.leaf, b.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256,
       c.f AS folded_root, c.f = r.h AS verified
FROM climb c JOIN high r ON r.n = 1 AND c.tree = -1 AND c.lvl = r.lvl
JOIN low b ON b.tree = c.start AND b.n = 1
""",
    "op12_spelling_variants": f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), told AS (
  SELECT run, count(*) AS n,
    {_crc32("""list_concat(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':', ''), lambda x: ascii(x)),
      flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN ascii(x) < 128 THEN [ascii(x)]
        ELSE [195, ascii(x) - 64] END)))""", "any_value(crc_table)")} AS h
  FROM runs, crc WHERE length(run) >= 7 GROUP BY doc_id, run
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
         ELSE run END AS word, sum(n)::BIGINT AS n
  FROM told GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), less AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), near AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT w.word, l.word FROM words w JOIN less l ON l.rest = w.word
  UNION
  SELECT l.word, w.word FROM words w JOIN less l ON l.rest = w.word
), best AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS most, arg_min(b, (-n, b)) AS nearest
  FROM near JOIN words ON words.word = b GROUP BY a
), formed AS (
  SELECT word, CASE WHEN most >= 10 * n THEN nearest END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN most >= 10 * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word)
), up(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT up.word, form FROM up JOIN formed f ON f.word = up.root WHERE form IS NOT NULL
)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n
FROM formed f JOIN up ON up.word = f.word JOIN formed r ON r.word = up.root AND r.form IS NULL
""",
}
