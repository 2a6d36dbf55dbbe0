"""Decontamination, language-model scores and toxicity."""

import math
import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from tagweave.llm import lm_score as lm
from tagweave.llm import toxicity as tx
from tagweave.llm.decontaminate import ItemIndex, contained_items, decontaminate, sketch_length

SCHEMA = "doc_id long, text string, item_id long, score double"


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


# --- decontamination ---


def norm(text):
    return [w for w in (text or "").encode().lower().translate(None, string.punctuation.encode()).split()]


def grams(words, width):
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_contained(docs, items):
    out = Counter()
    for item_id, text in set(items):
        words = norm(text)
        if not words:
            continue
        own = grams(words, min(5, len(words)))
        for row in docs:
            shared = len(own & grams(norm(row[1]), min(5, len(words))))
            if 5 * shared >= 4 * len(own):
                out[(row[0], item_id, shared, len(own))] += 1
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(1, 60))) for k in range(30)] + [(30, None), (31, ""), (32, "..."), (1, "two words")]
    items += [items[0], (40, items[5][1])]  # a repeated row and a second id
    docs = []
    for k in range(60):
        text = prose(rng, rng.randint(0, 300))
        if k % 3 == 0:
            words = items[k % 30][1].split()
            if k % 2:
                words[len(words) // 2] = "changed"
            at = rng.randrange(len(text) + 1)
            text = text[:at] + " " + " ".join(words).upper() + ", " + text[at:]
        docs.append((k, text, 5, None))
    docs += [(None, items[7][1], 1, 1.0), (3, items[7][1], 1, 1.0), (3, items[7][1], 1, 1.0), (99, None, 1, 1.0), (98, "", 1, 1.0)]
    docs.append((97, prose(rng, 60_000) + " " + items[20][1], 1, None))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_contained_items(spark, leaks, block_bytes):
    docs, items = leaks
    d = spark.createDataFrame(docs, SCHEMA).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    found = contained_items(d, i, block_bytes=block_bytes).collect()
    want = brute_contained(docs, items)
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found) == want and want
    assert all(r.containment == r.n_shared / r.n_item for r in found)
    clean = decontaminate(d, i, block_bytes=block_bytes)
    assert clean.columns == d.columns
    bad = Counter(k[0] for k in want)
    by_text = Counter((r[0], r[1]) for r in docs)
    kept = Counter((r.doc_id, r.text) for r in clean.collect())
    assert set(kept) == {k for k in by_text if not any(w[0] == k[0] for w in brute_contained([k], items))}
    assert sum(kept.values()) <= sum(by_text.values()) - len(bad)


def test_sketch_misses_no_contained_item():
    for size in range(1, 200):
        k = sketch_length(size, 0.8)
        missing = size - math.ceil(0.8 * size - 1e-9)
        assert k > missing or k == size


def test_no_items_or_documents(spark, leaks):
    docs, items = leaks
    d = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contained_items(d, none).count() == 0 and decontaminate(d, none).count() == len(docs)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert contained_items(d.limit(0), i).count() == 0
    assert list(ItemIndex([]).search(["a b c"])) == []


# --- language model ---


def lm_tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.mark.parametrize("frequent", [8, 1 << 20])
def test_base_scores_are_exact(spark, frequent):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randint(0, 80), "abc"), 1, 1.0) for k in range(80)]
    rows += [(None, "A a B", 1, 1.0), (80, None, 1, None), (81, "", 1, None), (5, rows[5][1], 1, 1.0), (82, "x\x0by\x0cz w\x1cv", 1, 1.0)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(t for r in rows if not held(r[0]) for t in lm_tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        tokens = lm_tokens(r[1])
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        want[(r[0], held(r[0]), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6))] += 1
    got = lm.lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), max_frequent=frequent).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_filter_reads_levels_back():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 3000, dtype=np.uint64)
    counts = np.random.default_rng(6).integers(1, 5000, 3000)
    bits = np.zeros(lm.SEGMENT_BITS, dtype=bool)
    for key, level in zip(keys, lm.level_of(counts).tolist()):
        for j in range(1, level + 1):
            _, at, stride = lm._spots(np.array([key]), j, 1)
            for _ in range(lm.PROBES):
                bits[int(at[0])] = True
                at = (at + stride) & np.uint64(lm.SEGMENT_BITS - 1)
    held = lm.Filter(np.packbits(bits, bitorder="little"))
    assert (held.levels(keys) >= lm.level_of(counts)).all()
    assert (held.levels(keys) == lm.level_of(counts)).mean() > 0.99
    other = np.random.default_rng(7).integers(0, 1 << 63, 3000, dtype=np.uint64)
    assert (held.levels(other) > 0).mean() < 0.01


def test_levels_and_values():
    counts = np.arange(1, 3000)
    value = lm.value_of(lm.level_of(counts))
    assert (np.abs(value - counts) <= 0.5 * counts).all() and lm.level_of(np.array([0]))[0] == 0


def test_model_predicts_held_out_text(spark):
    """Held-out sentences of a fixed grammar score better than by single words."""
    rng = random.Random(8)
    after = {w: [rng.choice("bcdefghijklmnop") for _ in range(2)] for w in "abcdefghijklmnop"}

    def sentence():
        w, out = "a", []
        for _ in range(40):
            out.append(w)
            w = rng.choice(after[w])
        return " ".join(out)

    got = lm.lm_scores(spark.createDataFrame([(k, sentence(), 1, 1.0) for k in range(300)], SCHEMA)).filter("held_out").collect()
    assert got and sum(r.score > r.base_score for r in got) > 0.95 * len(got)


def test_remembered_levels_are_those_of_the_filter():
    """Far more keys than places, asked in any order and again: the same levels as without memory."""
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 256, lm.SEGMENT_BITS // 8, dtype=np.uint8) | rng.integers(0, 256, lm.SEGMENT_BITS // 8, dtype=np.uint8)
    keys = np.append(rng.integers(0, 1 << 63, 400, dtype=np.uint64), np.uint64(0))
    plain = np.array([lm.Filter(bits).levels(keys[i : i + 1])[0] for i in range(len(keys))])
    assert plain.max() > 0 and plain.min() == 0
    held = lm.Filter(bits, remembered=64)
    for _ in range(5):
        order = rng.permutation(np.repeat(np.arange(len(keys)), 2))
        assert (held.levels(keys[order]) == plain[order]).all()


def brute_scores(texts, train):
    """Scores of the discounted bigram model with counts rounded to their levels, without a filter."""
    pairs, words = Counter(), Counter()
    for text in train:
        tokens = lm_tokens(text)
        pairs.update(zip(["<", *tokens], tokens))
        words.update([*tokens, "<"])
    followers = Counter(a for a, _ in pairs)
    scale = sum(words.values()) - words["<"] + 0.1 * len(words.keys() - {"<"}) + 0.1
    value = lambda c: float(lm.value_of(lm.level_of(np.array([c])))[0])
    out = []
    for text in texts:
        tokens, score = lm_tokens(text), 0.0
        for a, b in zip(["<", *tokens], tokens):
            p = (value(words[b]) + 0.1) / scale
            if words[a]:
                seen = max(value(pairs[a, b]) - lm.DISCOUNT, 0)
                p = min(1.0, (seen + lm.DISCOUNT * value(followers[a]) * p) / value(words[a]))
            score += math.log10(p)
        out.append(score)
    return out


def lm_case():
    rng = random.Random(11)
    rows = [(k, prose(rng, rng.randint(0, 60), "abcd"), 1, 1.0) for k in range(120)]
    rows += [(200, "only once", 1, 1.0), (201, None, 1, 1.0), (200, "only once more", 1, 1.0)]
    train = [r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    return rows, train


def test_single_pairs_are_held(spark):
    """Pairs seen once give their 0.25, and their contexts back off by the rest."""
    rows, train = lm_case()
    got = sorted((r.doc_id, r.score) for r in lm.lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want = sorted(zip([r[0] for r in rows], brute_scores([r[1] for r in rows], train)))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)


def test_followers_of_one_word_are_spread():
    """Entries of a word with 40,000 followers go to all slices evenly."""
    import pandas as pd

    text = " ".join(f"the w{k}" for k in range(40_000))
    sent = pd.concat(lm._count(8)([pd.DataFrame({"text": [text]})]))
    pairs = sent[sent["kind"] == 2]
    sizes = [len(c) // 8 for c in pairs["counts"]]
    assert sum(sizes) == 80_001 and len(sizes) == 8 and max(sizes) < 1.1 * sum(sizes) / 8
    added = pd.concat(lm._add_up(part) for _, part in sent.groupby("slice"))
    heads = pd.concat(lm._deal_heads(8)([added]))
    summed = pd.concat(lm._add_heads(part) for _, part in heads.groupby("slice"))
    counts = np.concatenate([np.frombuffer(c, np.int64) for c in summed["counts"]])
    assert sorted(counts.tolist())[-2:] == [1, 40_000] and counts.sum() == 80_001


def test_filter_beyond_its_broadcast(spark, monkeypatch):
    """A filter that is too large to broadcast drops nothing: scores are the same, segment by segment."""
    rows, train = lm_case()
    monkeypatch.setattr(lm, "SCORE_TOKENS", 100)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    alone = sorted(r.score for r in lm.lm_scores(docs, max_filter_bytes=100).collect())
    assert np.allclose(alone, sorted(brute_scores([r[1] for r in rows], train)), atol=1e-6)
    monkeypatch.setattr(lm, "SEGMENT_BITS", 1 << 14)  # several segments
    assert lm.train(docs.na.fill("").select("text")).segments > 3
    whole = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.lm_scores(docs).collect())
    got = lm.lm_scores(docs, max_filter_bytes=100).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == whole


def test_segments_answer_like_the_whole_filter(monkeypatch):
    """Keys dealt to several segments get the levels that the whole filter gives."""
    import pandas as pd

    rng = np.random.default_rng(3)
    segments, size = 3, lm.SEGMENT_BITS // 8
    bits = rng.integers(0, 256, segments * size).astype(np.uint8) | rng.integers(0, 256, segments * size).astype(np.uint8)
    keys = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    order, borders = lm._by_segment(keys, segments)
    rows = []
    for s in range(segments):
        rows.append((-1, s, bits[s * size : (s + 1) * size].tobytes()))
        rows.append((7, s, keys[order[borders[s] : borders[s + 1]]].tobytes()))
    frames = [pd.DataFrame([r], columns=["batch", "segment", "data"]) for r in rows]
    answers = pd.concat(lm._answer(frames))
    levels = np.empty(len(keys), np.int64)
    for s, data in zip(answers["segment"], answers["data"]):
        levels[order[borders[s] : borders[s + 1]]] = np.frombuffer(data, np.uint8)
    want = lm.Filter(bits).levels(keys)
    assert (levels == want).all() and want.max() > 0


def test_lm_empty_and_untrained(spark):
    assert lm.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = lm.lm_scores(spark.createDataFrame([(i, "a b", 1, 1.0) for i in held], SCHEMA)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score for r in got)


# --- toxicity ---


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        bad = k % 5 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Foul!", "vile", "NASTY,"]))
        rows.append((k, " ".join(words), 1, 0.5))
        if k % 10 != 3:
            labels.append((k, int(bad), 1))
    rows += [(None, "vile", 1, 0.5), (7, None, 1, 0.5), (7, "", 1, 0.5), (5000, "vile nasty foul " * 20_000, 1, 0.5)]
    labels += [(None, 1, 1), (8, None, 1), (77777, 1, 1), (9, 2, 0)]
    return (
        spark.createDataFrame(rows, SCHEMA).repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int"),
        rows,
    )


def test_toxicity_learns_held_out_rows(toxic):
    docs, labels, rows = toxic
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    wrong = sum(r.predicted != (r.doc_id % 5 == 0) for r in held)
    assert wrong <= 0.03 * len(held)
    assert all(r.predicted == 1 for r in got if r.doc_id == 5000)


def test_features_ignore_other_columns(toxic):
    docs, labels, _ = toxic
    first = {(r.doc_id, round(r.score, 9)) for r in tx.toxicity(docs, labels).collect()}
    other = docs.drop("score", "item_id").withColumnRenamed("text", "text")
    assert {(r.doc_id, round(r.score, 9)) for r in tx.toxicity(other, labels).collect()} == first


def test_toxicity_without_labels(spark, toxic):
    docs, labels, rows = toxic
    got = tx.toxicity(docs, labels.limit(0)).collect()
    assert len(got) == len(rows) and {r.predicted for r in got} == {0}
    assert tx.toxicity(docs.limit(0), labels).count() == 0
