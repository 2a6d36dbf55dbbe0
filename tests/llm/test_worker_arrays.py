"""What Python workers do with whole arrays instead of word by word or place by place."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from tagweave.llm import lm_score, suffix_dedup, toxicity
from tagweave.llm.common import WordHash, word_arrays


def test_words_are_hashed_together():
    texts = ["", " \t", "a Bb\x0bccc\x1cd\x85é", "x" * 31 + "\r\n" + "Y" * 32, *("".join(map(chr, range(65, 65 + n))) for n in range(1, 45)), "..!"]
    for lower in (False, True):
        for drop in (b"", b".!"):
            raws = [t.encode().translate(None, drop) for t in texts]
            words = [(r.lower() if lower else r).split() for r in raws]
            cache = WordHash()
            hashes, counts = word_arrays(texts, cache, lower, drop)
            assert counts.tolist() == [len(w) for w in words]
            assert hashes.tolist() == [xxhash.xxh64_intdigest(w) for own in words for w in own]
            assert all(len(w) >= 32 for w in cache)  # short words are not looked up one by one
    assert [len(x) for x in word_arrays([], WordHash())] == [0, 0]


def test_pairs_are_counted_as_numbers():
    """Followers that are the same in 40 bits are one."""
    words = np.array([3, 1 << 30, (1 << 30) + 1, 1 << 50], np.uint64)
    rng = np.random.default_rng(1)
    first, second = rng.integers(0, 4, 200), rng.integers(0, 4, 200)
    want = Counter((int(words[a]), int(words[b]) >> 24) for a, b in zip(first, second))
    a, b, c = lm_score._pair_counts(words, first, second)
    assert list(zip(zip(a.tolist(), b.tolist()), c.tolist())) == sorted(want.items())


def test_features_are_extracted_in_bounded_parts():
    texts = [f"word{k} " * 40_000 for k in range(10)]
    parts = list(toxicity._extract([pd.DataFrame({"text": texts, "label": 1, "fitted": True})]))
    assert len(parts) > 1 and sum(map(len, parts)) == 10
    assert all(len(np.frombuffer(f, np.int32)) == 3 for p in parts for f in p["features"])


def test_a_repeated_chunk_is_one_run():
    """Repeated starts become runs, whole chunks without their places, in one step for a batch."""
    flags = np.packbits([0, 1, 1, 0, 0, 0, 0, 0, 0, 1]).tobytes()
    packed = np.array([4, 6], np.int32).tobytes()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("starts", pa.int32()), ("copies", pa.int64()), ("flags", pa.binary()), ("merged", pa.list_(pa.binary()))]))
    chunk = lambda start, starts, copies, flags=None, merged=None: dict(start=start, starts=starts, copies=copies, flags=flags, merged=merged)
    found = pa.array([[chunk(0, 1000, 2, flags)], None, [chunk(5, 10, 1, flags), chunk(40, 9, 1, None, [packed])]], kind)
    low, high = suffix_dedup._repeats(found.flatten(), np.array([0, 5000, 6000]))
    assert sorted(zip(low.tolist(), high.tolist())) == [(0, 999), (5001, 5002), (5009, 5009), (6004, 6004), (6006, 6006)]

    text = "0123456789" * 120
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, "", text]), found], names=["doc_id", "text", "found"])
    (out,) = suffix_dedup._cut(3)([batch])
    spans = [[(s["start"], s["end"]) for s in row] for row in out.column(3).to_pylist()]
    assert spans == [[(0, 1002)], [], [(6, 10), (14, 17), (44, 49)]]
    for kept, own in zip(out.column(1).to_pylist(), spans):
        gone = {k for a, b in own for k in range(a, b)}
        data = b"" if not own else text.encode()
        assert kept == bytes(x for k, x in enumerate(data) if k not in gone)
    assert out.column(2).to_pylist() == [1200, 0, 1200]


def _minimizer_rows(texts, slices):
    keys = np.arange(len(texts)) + 7
    pdf = pd.DataFrame({"key": keys, "text": texts})
    rows = suffix_dedup._occurrences(200, 48, slices)([pdf.iloc[:3], pdf.iloc[3:]])
    return [own.reset_index(drop=True) for _, own in pd.concat(rows).groupby("slice")]


def test_minimizers_spread_over_the_slices():
    """A task counts one slice, so no slice may hold most minimizers, though their hashes are small."""
    text = np.random.default_rng(4).integers(97, 123, 600_000).astype(np.uint8).tobytes().decode()
    held = [sum(len(o) // 4 for o in own["owner"]) for own in _minimizer_rows([text], 40)]
    assert len(held) == 40 and sum(held) > 7000
    assert max(held) < 2 * sum(held) / 40


def test_a_text_that_repeats_itself_sends_few_minimizers(monkeypatch):
    """A minimizer that a piece of text has many times is sent once, and all its occurrences count."""
    rng = np.random.default_rng(5)
    line = rng.integers(97, 123, 400).astype(np.uint8).tobytes().decode()
    own = rng.integers(97, 123, 2000).astype(np.uint8).tobytes().decode()
    texts = ["x" * 30_000, line * 40, "", "short", own + line, own[:1500], line]
    monkeypatch.setattr(suffix_dedup, "PIECE", 9000)
    monkeypatch.setattr(suffix_dedup, "GRAM_SLICE", 20)
    times, keys = Counter(), {}
    for pieces, owner, _ in suffix_dedup._groups(texts, 200):
        hashes, piece, _, _ = suffix_dedup.minimizers(pieces, 200, 48)
        times.update(hashes.tolist())
        for h, p in zip(hashes.tolist(), piece.tolist()):
            keys.setdefault(h, set()).add(owner[p] + 7)
    want = {(k, np.uint64(h).view(np.int64), n) for h, n in times.items() if n > 1 for k in keys[h]}
    slices = _minimizer_rows(texts, 12)
    found = pd.concat([suffix_dedup._repeated(own) for own in slices])
    assert sorted(found.itertuples(index=False, name=None)) == sorted(want)
    assert sum(len(o) // 4 for own in slices for o in own["owner"]) < 200 < times.most_common(1)[0][1]
