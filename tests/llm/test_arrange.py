"""Packing, sharding and extraction."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagweave.llm import html_extract as he
from tagweave.llm import packing as pk
from tagweave.llm import sharding as sh
from tagweave.llm.common import planes, rolling, tokenizer_path, unplanes, windows

SCHEMA = "doc_id long, text string, shard int, slot string"
TOKENIZER = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdeéß!'") for _ in range(rng.randint(1, 8))) for _ in range(n))
    texts = [None, "", " \n", "<|endoftext|> x", "don't WON'T ﬁne Ǆ ́ İ", prose(9000)] + [prose(rng.randint(0, 400)) for _ in range(80)]
    texts += [texts[10]] * 40
    return [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "null id", 1, "x"), (3, "again", 1, "x"), (3, "again", 1, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# --- packing ---


def test_words_match_the_tokenizer(rows):
    from tokenizers import Tokenizer

    path = tokenizer_path(TOKENIZER)
    ids, whole = pk.TokenIds(path), Tokenizer.from_file(path)
    for _, text, *_ in rows:
        got = np.frombuffer(ids.ids(text or ""), "<u4").tolist()
        assert got == whole.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_word_matches_the_tokenizer(text):
    from tokenizers import Tokenizer

    if not hasattr(test_any_word_matches_the_tokenizer, "pair"):
        path = tokenizer_path(TOKENIZER)
        test_any_word_matches_the_tokenizer.pair = pk.TokenIds(path), Tokenizer.from_file(path)
    ids, whole = test_any_word_matches_the_tokenizer.pair
    assert np.frombuffer(ids.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_round_trip(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    want = defaultdict(list)
    for i, text, *_ in rows:
        want[i].append(np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    got = pk.pack_documents(docs, tokenizer_path(TOKENIZER)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        assert sum(r.length for r in parts) == sum(len(x) // 4 for x in want[i])
        if len(want[i]) == 1:
            at = 0
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(want[i][0]) // 4
                at += r.length
                assert r.ids_crc32 == zlib.crc32(want[i][0][4 * r.start : 4 * at])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_segment_limit(docs):
    got = pk.pack_documents(docs, tokenizer_path(TOKENIZER), max_tokens=512, max_segments=3, max_loss=400).collect()
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r.length)
    assert all(len(x) <= 3 and sum(x) <= 400 for x in by_sequence.values())


def test_examples_keep_all_limits(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(1, 900), rng.randint(1, 6), rng.randint(0, 500)) for k in range(700)]
    rows += [(None, 10, 1, None), (9000, 5000, 1, 1), (9001, None, None, None)]
    examples = spark.createDataFrame(rows, "id long, tokens int, turns int, loss int").repartition(2)
    limits = {"tokens": 2048, "turns": 12, "loss": 900}
    got = pk.pack_examples(examples, limits, "id").collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in rows)
    demand = {r[0]: [x or 0 for x in r[1:]] for r in rows}
    sums = defaultdict(lambda: np.zeros(3))
    for r in got:
        if r.over:
            assert r.id == 9000
        else:
            sums[r.sequence_id] += demand[r.id]
    assert all((s <= list(limits.values())).all() for s in sums.values())
    least = max(sum(d[k] for i, d in demand.items() if i != 9000) / c for k, c in enumerate(limits.values()))
    assert len(sums) <= 1.25 * least + 4


# --- sharding ---


def test_best_fit_matches_a_plain_search():
    rng = random.Random(5)
    for _ in range(100):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        capacity = rng.choice([100, 130, 333])
        left, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [(r, b) for b, r in enumerate(left) if r >= sizes[i]]
            at = min(fit)[1] if fit else len(left)
            left += [] if fit else [capacity]
            left[at] -= sizes[i]
            want[i] = at
        assert sh.best_fit_decreasing(sizes, capacity) == want


def test_shards(docs, rows):
    got = sh.shard_documents(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    shard_of, slots, load = {}, defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = defaultdict(set)
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[(str(i), size(t), zlib.crc32((t or "").encode()))].add(t or "")
    for r in got:
        for t in texts[(str(r.doc_id), r.size, r.text_crc32)]:
            by_text[t].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    groups = defaultdict(int)
    for _, t, *_ in rows:
        groups[t] += size(t)
    mean = sum(load.values()) / 8
    assert max(load.values()) <= max(1.02 * mean, max(groups.values()) + 1)


def test_shards_of_nothing(spark):
    assert sh.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


# --- extraction ---

ARTICLE = "A long enough sentence of an article, with some words in it, that ends in a stop."
PAGES = [
    (1, "u", f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title</h1><p>{ARTICLE}</p></article><footer>&copy; x</footer></body></html>",
     f"Title\n{ARTICLE}"),
    (2, "u", f"<body><div class='cookie-banner'><p>{ARTICLE}</p></div><main><h2>T &amp;amp; &lt;b&gt;</h2><p>one<br>two  <b>three</b>\n four<ul><li>Point</ul></main><aside class=sidebar><p>{ARTICLE}</p></aside>",
     "T &amp; <b>\none two three four\nPoint"),
    (3, "u", f"<div class=menu><a>A</a></div><div class='post-content'><p>{ARTICLE}<p>Short.</div><section class=comments><p>{ARTICLE}</p><form><p>Name</p></form></section><script>var a='<p>no</p>'</script><!-- <p>no</p> --><style>p{{}}</style>",
     f"{ARTICLE}\nShort."),
    (4, "u", None, ""), (5, "u", "", ""), (6, "u", "<<p a=\"x>y<", None), (None, None, f"<article><p>{ARTICLE}", ARTICLE),
]


def test_extracts_articles_only(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = he.fit(table)
    pages = spark.createDataFrame([p[:3] + ("clash", 7) for p in PAGES], "page_id long, url string, html string, text string, n_chars long")
    got = {r.page_id: r for r in he.extract(pages, weights).collect()}
    assert len(got) == len(PAGES)
    for number, _, _, want in PAGES:
        assert want is None or got[number].text == want
        assert got[number].n_chars == len(got[number].text)


@pytest.mark.parametrize("tag", ["svg", "canvas", "object", "select"])
def test_unclosed_elements_hide_nothing(tag):
    page = f"<article><p>{ARTICLE}</p><{tag} class=x><p>Second.</p><{tag}><p>Third.</p></article>"
    assert [b.text for b in he.blocks_of(page)] == [ARTICLE, "Second.", "Third."]
    closed = f"<article><p>One.</p><{tag}>hidden</{tag}><p>Two.</p><{tag}><p>Three.</p></article>"
    assert [b.text for b in he.blocks_of(closed)] == ["One.", "Two.", "Three."]


@pytest.mark.parametrize("tag", ["script", "style", "title", "textarea", "iframe", "noscript", "template"])
def test_unclosed_raw_text_hides_the_rest(tag):
    assert [b.text for b in he.blocks_of(f"<p>One.</p><{tag}><p>Two.</p>")] == ["One."]


def test_formulas_and_unclosed_elements_in_articles(spark):
    formula = "<math><mi>x</mi><mo>+</mo><mn>1</mn></math>"
    pages = [
        (1, "u", f"<nav><a href=x>Home</a></nav><article><p>{ARTICLE}</p><p>So {formula} holds here, with some words in it, to the end.</p></article>",
         f"{ARTICLE}\nSo x+1 holds here, with some words in it, to the end."),
        (2, "u", f"<nav><a href=x>Home</a></nav><article><p>{ARTICLE}</p><svg viewBox='0 0 1 1'><p>{ARTICLE}</p></article>", f"{ARTICLE}\n{ARTICLE}"),
    ]
    weights = he.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    got = he.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string"), weights)
    assert {r.page_id: r.text for r in got.collect()} == {p[0]: p[3] for p in pages}


def test_held_out_pages_are_exact(spark):
    """Blocks of pages that training has not seen get their publisher's labels."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    some = table.filter("page_id % 4 = 0")
    texts = {r.page_id: r.text for r in he.extract(table, he.fit(some)).collect()}
    for r in table.filter("page_id % 4 <> 0").collect():
        blocks = he.blocks_of(r.html)
        assert texts[r.page_id] == "\n".join(b.text for b in blocks if he.label(b))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        scores, move = rng.normal(size=n), rng.normal(size=(2, 2))
        best = max(
            range(2**n),
            key=lambda m: sum(scores[i] for i in range(n) if m >> i & 1)
            + sum(move[m >> i & 1, m >> i + 1 & 1] for i in range(n - 1)),
        )
        assert he.viterbi(scores.tolist(), move) == [best >> i & 1 for i in range(n)]


def test_pages_without_labels(spark):
    pages = spark.createDataFrame([(1, "u", f"<div><p>{ARTICLE}</p></div>")] * 3, "page_id long, url string, html string")
    assert he.extract_pages(pages).count() == 3
    assert he.extract_pages(pages.limit(0)).count() == 0


# --- helpers ---


def test_rolling_and_windows():
    values = np.arange(1, 50, dtype=np.uint64)
    for width in (1, 2, 5, 25, 48, 49, 50):
        hashes = rolling(values, width)
        assert len(hashes) == max(0, 50 - width)
        assert len(set(hashes.tolist())) == len(hashes)
    at, doc = windows(np.array([3, 0, 1, 4]), 3)
    assert at.tolist() == [0, 4, 5] and doc.tolist() == [0, 3, 3]
    again = unplanes(planes(values), np.uint64)
    assert (again == values).all()
