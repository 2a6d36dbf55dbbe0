"""Exact dedup, near dedup, passages and strings against brute force on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import exact_dedup as ex
from tagweave.llm import suffix_dedup as sx
from tagweave.llm.jaccard_join import drop_near_duplicates, intersections, jaccard_join, prefix_length
from tagweave.llm.substring_dedup import drop_repeated_passages

SCHEMA = "doc_id long, text string, lang string, key long, rank long, score double"


def awkward_rows():
    """Null and empty texts, white space, a long text, copies, repeated rows, shared passages."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long_text = prose(90), prose(9000)
    texts = [None, "", " ", "\t\n", "one", "One", "a b", "a  b", "a b", long_text, long_text + " x", shared]
    texts += [prose(30) + " " + shared + " " + prose(40) for _ in range(6)]
    base = prose(120).split()
    for k in range(12):
        own = list(base)
        own[rng.randrange(len(own))] = f"w{k}"
        texts.append(" ".join(own))
    texts += ["ab " * 300, "ab " * 301, "é" * 250, "x" + "é" * 250, prose(3)] + [prose(200)] * 5
    rows = [(i, t, None if i % 5 == 0 else "en", 1, 2, None) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """The same with null and repeated ids, and repeated rows."""
    more = [(None, rows[11][1], "en", 1, 2, None)] * 2 + [rows[11], rows[4], (4, "other", "en", 1, 2, None)]
    return spark.createDataFrame(rows + more, SCHEMA).repartition(3), rows + more


def folded(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_exact_groups(docs, rows, block):
    groups = defaultdict(list)
    for r in rows:
        groups[folded(r[1])].append(r[0])
    want = {
        r[0]: (min(g), len(g), r[0] == min(g), hashlib.sha256(folded(r[1]).encode()).hexdigest())
        for r in rows
        for g in [groups[folded(r[1])]]
    }
    if block == 1:  # many naming rounds, on short texts only
        docs = docs.filter("text is null or length(text) < 700")
        want = {r[0]: want[r[0]] for r in rows if r[1] is None or len(r[1]) < 700}
    got = {r[0]: tuple(r)[1:] for r in ex.exact_dedup(docs, block_bytes=block).collect()}
    assert got == want


def test_exact_names_survive_colliding_keys(docs, rows):
    """Keys of few bits stand for several blocks; naming goes on until a seed tells all apart."""

    tries = []

    def weak(seed, block):
        tries.append(seed)
        return F.pmod(F.xxhash64(F.lit(seed), block), F.lit(3 if seed < 44 else 1 << 40))

    got = ex.exact_dedup(docs, block_bytes=64, key=weak)
    assert got.filter("kept").count() == len({folded(r[1]) for r in rows}) and max(tries) >= 44


def test_exact_null_and_repeated_ids(odd):
    docs, rows = odd
    kept = ex.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(folded(r.text) for r in kept.collect()) == Counter({folded(r[1]) for r in rows})
    first = {r.text_sha256: r for r in ex.exact_dedup(docs).filter("kept").collect()}
    shared = first[hashlib.sha256(folded(rows[11][1]).encode()).hexdigest()]
    assert (shared.doc_id, shared.keep_id, shared.group_size) == (11, 11, 4)


def shingles(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def near_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    links = [
        [j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        for i in range(n)
    ]
    seen, classes = set(), []
    for i in range(n):
        if i not in seen:
            todo, own = [i], set()
            while todo:
                k = todo.pop()
                if k not in own:
                    own.add(k)
                    todo += links[k]
            seen |= own
            classes.append(own)
    return links, classes


def test_jaccard_classes_and_links(docs, rows):
    links, classes = near_classes(rows)
    want = {}
    for c in classes:
        for i in c:
            want[rows[i][0]] = (min(rows[k][0] for k in c), len(links[i]))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs).collect()}
    assert got == want


def test_jaccard_small_blocks_and_repeated_rows(odd, monkeypatch):
    docs, rows = odd
    links, classes = near_classes(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)
    from tagweave.llm.jaccard_join import near_duplicates

    got = near_duplicates(docs, block=4).collect()
    assert sorted(r.n_links for r in got) == sorted(len(x) for x in links)
    assert len({r.root for r in got}) == len(classes)


def test_prefix_is_shortened_to_the_target():
    assert prefix_length(0.8, 40, 8, 0.5) == 8
    depth = prefix_length(0.8, 40, 8, 0.999999)
    assert 1 - (1 - 0.8**depth) ** 40 >= 0.999999 > 1 - (1 - 0.8 ** (depth + 1)) ** 40


def test_intersections_match_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
    got = intersections(sets[:7], sets[5:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[5:]] for a in sets[:7]]


def brute_passages(rows, window):
    """(kept words, removed words) per row; rank of a null id is behind all."""
    words = [(r[1] or "").encode().split() for r in rows]
    rank = [r[0] if r[0] is not None else 1 << 62 for r in rows]
    least = {}
    for w, k in zip(words, rank):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, k), k)
    out = []
    for w, k in zip(words, rank):
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < k:
                gone[i : i + window] = b"\1" * window
        out.append((b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone)))
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_passages(odd, window):
    docs, rows = odd
    got = [
        (r.text, r.n_words, sum(s.end - s.start for s in r.removed))
        for r in drop_repeated_passages(docs, window=window).collect()
    ]
    assert Counter(got) == Counter(brute_passages(rows, window))


def brute_strings(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((bytes(x for x, g in zip(d, gone) if not g), len(d), sum(gone), spans))
    return out


@pytest.mark.parametrize("split", [4096, 2])
def test_strings(odd, split, monkeypatch):
    monkeypatch.setattr(sx, "SPLIT", split)
    docs, rows = odd
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 3000 else r[1][:3000]) for r in rows]
    docs = docs.withColumn("text", F.substring("text", 1, 3000))
    got = [
        (bytes(r.kept), r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed))
        for r in sx.drop_repeated_strings(docs).collect()
    ]
    assert Counter(got) == Counter(brute_strings(rows, 200))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(40):
        n = int(rng.integers(1, 300))
        text = rng.integers(97, 97 + 1 + trial % 3, n).astype(np.uint8)
        raw = text.tobytes()
        order = sx.suffix_array(text, 64)
        assert [raw[i : i + 64] for i in order] == sorted(raw[i : i + 64] for i in range(n))
        shared = sx.common_prefixes(text, order, 20)
        for k in range(1, n):
            a, b = raw[order[k] :][:20], raw[order[k - 1] :][:20]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_runs_merge_by_binary_search():
    runs = [np.array(x, np.uint64) for x in ([1, 3, 3, 9], [2, 3], [], [9, 10], [1])]
    assert sx.merge_runs(runs).tolist() == [1, 3, 9]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ex.exact_dedup(none).count() == 0
    assert jaccard_join(none).count() == 0
    assert drop_repeated_passages(none).count() == 0
    assert sx.drop_repeated_strings(none).count() == 0
    blank = spark.createDataFrame([(1, None, "en", 1, 1, None), (2, "", None, 1, 1, None)], SCHEMA)
    assert sx.drop_repeated_strings(blank).select("n_bytes").collect() == [(0,), (0,)]
    assert {r.n_links for r in jaccard_join(blank).collect()} == {0}


def test_clashing_key_columns_come_back(spark):
    """A column with the name of the row key is the user's own, whatever its case."""
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame(
        [(1, text, "mine", 5), (2, text, "other", 6), (3, "else", "x", 7)], "doc_id long, text string, __row_key string, __ROW_KEY_ int"
    )
    for drop in (ex.drop_copies, drop_near_duplicates):
        got = drop(docs)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == [(1, text, "mine", 5), (3, "else", "x", 7)]
