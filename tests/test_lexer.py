"""The joint lexer against a character-level simulation."""

import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators.lexer import joined_blocks, lex, line_blocks, strip_blocks, strip_joint
from tagweave.operators.match import document_tokens


def directive(line):
    s = line.lstrip(" \t")
    return s[1:].lstrip(" \t") if s.startswith("#") else ""


def simulate(text, directives=True):
    """One character at a time; a token that never closes is put back as code."""
    out, i, start = [], 0, True
    while i < len(text):
        if start and directives:
            line = text[i:].split("\n", 1)[0]
            if directive(line).startswith("if 0"):
                depth = 0
                while i < len(text):
                    line = text[i:].split("\n", 1)[0]
                    name = directive(line)
                    depth += name.startswith("if") - name.startswith("endif")
                    i += len(line) + 1
                    if depth == 0:
                        break
                continue
        start = text[i] == "\n"
        two = text[i : i + 2]
        if two == "//":
            while i < len(text) and text[i] != "\n":
                i += 1
            out.append(" ")
            start = False
        elif two == "/*" and "*/" in text[i + 2 :]:
            i = text.index("*/", i + 2) + 2
            out.append(" ")
            start = False
        elif text[i] in "\"'":
            j = i + 1
            while j < len(text) and text[j] != text[i]:
                j += 2 if text[j] == "\\" else 1
            if j < len(text):
                out.append(" ")
                i = j + 1
            else:
                out.append(text[i])
                i += 1
            start = False
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


PIECES = ["/*", "*/", "//", '"', "'", "\\", "\n", "\n", "\n#if 0\n", "\n # if 0x\n", "\n#ifdef A\n", "\n#endif\n", "\n#endif",
          "\n#else\n", "#if 0", " ", "ab", "c;", "*", "/", "#", "\n\t#  endif // x\n"]


def some_texts(count, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(count)]


GOLDEN = [
    ("/*\n#if 0\n*/\nlive();", " \nlive();"),
    ('s = "\n#if 0\n";\nlive();', "s =  ;\nlive();"),
    ("#if 0\n/*\n#endif\nlive();", "live();"),
    ("a\n#if 0\nb\n#if X\nc\n#endif\nd\n#endif\ne", "a\ne"),
    ("a\n#if 0\nb", "a\n"),
    ("it's\n#if 0\nx\n#endif\ny", "it's\ny"),
    ("x /* y\n#if 0\nz\n", "x /* y\n"),
]


@pytest.mark.parametrize("text, want", GOLDEN)
def test_golden(text, want):
    assert simulate(text) == want and lex(text, True)[0] == want


def test_lex_equals_simulation():
    for text in some_texts(4000):
        for directives in (True, False):
            assert lex(text, directives)[0] == simulate(text, directives), text


@pytest.mark.parametrize("size", [1, 7, 60])
def test_blocks_equal_whole_texts(spark, size):
    texts = some_texts(400, seed=2) + [g for g, _ in GOLDEN] + ["", "\n" * 50 + "#if 0\n" * 30 + "#endif\n" * 29 + "x\n#endif\ny"]
    rows = [(i, ("c", "c++", "java", "python", None)[i % 5] if i < 400 else "c", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(9999, "c", None)], "doc_id long, lang string, text string")
    blocks = line_blocks(docs, size)
    assert size > 7 or blocks.count() > 2 * len(rows)
    got = {r["key"]: r["text"] for r in joined_blocks(strip_blocks(blocks)).collect()}
    for i, lang, text in rows:
        want = text if lang in ("python", None) else simulate(text, lang != "java")
        assert got[i] == want, (lang, text)


def test_rows_without_key(spark):
    """Null and repeated ids, null texts and languages: every row comes back with its own text."""
    rows = [(None, "c", "#if 0\na\n#endif\nb"), (1, "c", "#if 0\nc\n#endif\nd"), (1, "c++", "#if 0\ne\n#endif\nf"),
            (1, "java", "#if 0\ng // h"), (2, None, "#if 0"), (3, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("x", F.lit(1))
    got = sorted(map(tuple, strip_joint(docs).collect()), key=str)
    want = [(None, "c", "b", 1), (1, "c", "d", 1), (1, "c++", "f", 1), (1, "java", "#if 0\ng  ", 1), (2, None, "#if 0", 1), (3, "c", None, 1)]
    assert got == sorted(want, key=str)
    plan = strip_joint(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_tokens_of_a_directive_in_a_comment(spark):
    docs = spark.createDataFrame([(1, "c", "/*\n#if 0\n*/\nlive();\n#if 0\ndead();\n")], "doc_id long, lang string, text string")
    assert [r["name"] for r in document_tokens(docs).collect()] == ["live"]
