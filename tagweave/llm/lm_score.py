"""Language-model scores from a log-frequency Bloom filter.

The model is an absolutely discounted bigram model that backs off to
add-0.1 unigrams.  Its counts are held in one Bloom filter: a count becomes a
level on a logarithmic scale, and a key is inserted once for each level up to
its own, so the level is read back by probing level after level until one is
absent.  The filter holds three kinds of keys: word counts, bigram counts
(from one occurrence on) and each context's number of distinct followers, of
which every one gives ``DISCOUNT`` to the mass that backs off.

Counting covers every training token.  Tasks sum what they read into sorted
arrays of hashes and send one binary value per slice of the hash space, so a
frequent word or pair is one entry per task; each slice is then added up by
one task.  A pair's slice is that of both its words, so the followers of one
word are spread over all slices; their numbers per context are added up after
that, in slices by the context.  Slices have about ``SLICE_ITEMS`` entries,
their number grows with the input.

The filter is a table of segments of 1 MB whose number grows with the input;
every count of words, bigrams and followers is held at any size.  Up to
``MAX_FILTER_BYTES`` it is broadcast.  A larger one stays a table: texts are
cut into batches, each batch sends the distinct keys it asks for to their
segments and gets the levels back, which gives the same scores.  Tasks then
hold one segment or one batch at a time.

Base scores are exact.  The counts of the most frequent words (at most
``MAX_FREQUENT``) are broadcast; every other word of a text is joined with its
count.  Words are identified by 64-bit hashes.

Defined cases: a null or empty text is its end token alone; rows with a null
id are not held out; repeated rows are scored (and learned from) as often as
they stand there; without training rows every count is 0 and scores equal
base scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import (
    WordHash,
    cut,
    keyed,
    lean,
    mix,
    pack_sorted,
    planes,
    prepare,
    slice_of,
    stage,
    total_bytes,
    unpack_sorted,
    unplanes,
    word_arrays,
)
from tagweave.workers import ship_by_value

FOLDS = 10
ADD = 0.1
DISCOUNT = 0.75
#: Ratio of neighbouring levels of the logarithmic scale.
BASE = 1.5
#: Filter bits for each inserted (key, level), and hash functions.
BITS_PER_ITEM = 10
PROBES = 7
#: Largest filter that is broadcast; a larger one is asked segment by segment.
MAX_FILTER_BYTES = 128 << 20
SEGMENT_BITS = 1 << 23
MAX_FREQUENT = 1 << 20
#: Keys whose levels a task remembers (a power of two).
REMEMBERED = 1 << 21
SLICE_ITEMS = 1_500_000
#: Tokens that a task adds up, and tokens that it scores, at a time.
COUNT_TOKENS = 800_000
SCORE_TOKENS = 500_000

_END = np.uint64(0x5851F42D4C957F2D)
_BEGIN = np.uint64(0x14057B7EF767814F)
_WORD, _PAIR, _MASS = np.uint64(1), np.uint64(2), np.uint64(3)
_NEXT_BITS = np.uint64(24)  # a follower is known by the other 40 bits of its hash


# --- the logarithmic scale ------------------------------------------------------


def level_of(counts: np.ndarray) -> np.ndarray:
    """Level of each count; 0 for counts below 1."""
    c = np.asarray(counts, dtype=np.float64)
    out = 1 + np.floor(np.log(np.maximum(c, 1.0)) / np.log(BASE) + 1e-9)
    return np.where(c >= 1, out, 0).astype(np.int64)


def value_of(levels: np.ndarray) -> np.ndarray:
    """Mean of the whole counts of each level (0 for level 0)."""
    j = np.arange(int(np.max(levels, initial=0)) + 1, dtype=np.float64)
    low = np.ceil(BASE ** (j - 1) - 1e-9)
    high = np.maximum(low, np.ceil(BASE**j - 1e-9) - 1)
    return np.where(j > 0, (low + high) / 2, 0.0)[levels]


def _kind(keys: np.ndarray, kind: np.uint64) -> np.ndarray:
    return mix(keys, kind)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return slice_of(keys * np.uint64(0xD6E8FEB86659FD93), segments)


def _by_segment(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by their segment, and the segments' borders in it."""
    segment = _segment(keys, segments)
    order = np.argsort(segment, kind="stable")
    return order, np.searchsorted(segment[order], np.arange(segments + 1, dtype=np.uint64))


def _spots(keys: np.ndarray, level: int | np.ndarray, segments: int):
    """Segment, first position and stride of the probes of (key, level)."""
    h = mix(keys, np.asarray(level, dtype=np.uint64))
    segment = _segment(keys, segments)
    at = h & np.uint64(SEGMENT_BITS - 1)
    stride = ((h >> np.uint64(40)) | np.uint64(1)) & np.uint64(SEGMENT_BITS - 1)
    return segment, at, stride


class Filter:
    """Read side: a level is found by probing upwards from 1.

    Levels that were found are remembered in a table of fixed size, one key to a
    place: a key's level is the same however often it is asked, and frequent keys,
    which have the highest levels and so the most probes, come in every batch.  A
    key gives way only to one of the same or a higher level.
    """

    def __init__(self, bits: np.ndarray, remembered: int = REMEMBERED):
        self.bits, self.segments = bits, len(bits) * 8 // SEGMENT_BITS
        self.keys = np.zeros(remembered, np.uint64)
        self.held = np.full(remembered, -1, np.int8)  # -1: a free place

    def _holds(self, keys: np.ndarray, level: int) -> np.ndarray:
        segment, at, stride = _spots(keys, level, self.segments)
        base = segment * np.uint64(SEGMENT_BITS)
        alive = np.arange(len(keys))
        for _ in range(PROBES):
            place = base + at
            byte = self.bits[(place >> np.uint64(3)).view(np.int64)]
            stay = np.flatnonzero((byte >> (place & np.uint64(7)).astype(np.uint8)) & 1)
            alive, base, stride = alive[stay], base[stay], stride[stay]
            at = (at[stay] + stride) & np.uint64(SEGMENT_BITS - 1)
            if not len(alive):
                break
        return alive

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, 0 if it is not held."""
        if not self.segments:
            return np.zeros(len(keys), dtype=np.int64)
        place = (keys & np.uint64(len(self.keys) - 1)).view(np.int64)
        known = self.held[place]
        out = np.where(self.keys[place] == keys, known, np.int8(-1)).astype(np.int64)
        asked = np.flatnonzero(out < 0)
        out[asked] = 0
        open_, level = asked, 1
        while len(open_):
            open_ = open_[self._holds(keys[open_], level)]
            out[open_] = level
            level += 1
        # Of new keys that share a place the last one written stays, key and level alike.
        new = asked[out[asked] >= known[asked]]
        self.keys[place[new]], self.held[place[new]] = keys[new], out[new]
        return out


# --- counting -------------------------------------------------------------------


def _tokens(texts: list[str], cache: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with each text's end, the token before each, and token counts."""
    hashes, counts = word_arrays(texts, cache, lower=True)
    sizes = counts + 1
    ends = np.cumsum(sizes) - 1
    tokens = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[ends] = False
    tokens[inner] = hashes
    tokens[ends] = _END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate(([0], ends[:-1] + 1))] = _BEGIN
    return tokens, before, sizes


def _text_groups(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _summed(first: np.ndarray, second: np.ndarray, counts: np.ndarray):
    """Distinct pairs in ascending order with their summed counts."""
    order = np.lexsort((second, first))
    a, b, c = first[order], second[order], counts[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    return a[starts], b[starts], np.add.reduceat(c, starts) if len(starts) else c


def _pair_counts(words: np.ndarray, first: np.ndarray, second: np.ndarray):
    """Distinct (word before, follower) in ascending order with their counts, from the places
    of both in ``words`` (ascending).  Places make a pair one number, and plain numbers sort
    several times faster than two arrays."""
    codes = first * len(words) + second
    codes.sort()
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    first, second = np.divmod(codes[starts], len(words))
    a, b, c = words[first], words[second] >> _NEXT_BITS, np.diff(np.append(starts, len(codes)))
    new = np.ones(len(a), dtype=bool)  # different followers can be the same in 40 bits
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], np.add.reduceat(c, np.flatnonzero(new))


_COUNT_SCHEMA = "slice int, kind int, first binary, second binary, counts binary"


def _count(slices: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        cache = WordHash()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pd.DataFrame:
            tokens = np.concatenate([t for t, _ in held])
            before = np.concatenate([b for _, b in held])
            held.clear()
            rows = []
            words, place = np.unique(np.append(tokens, _BEGIN), return_inverse=True)
            begin = place[-1]
            previous = np.empty_like(place[:-1])
            previous[1:] = place[:-2]
            opens = before == _BEGIN
            previous[opens] = begin
            n = np.bincount(place[:-1], minlength=len(words))
            n[begin] += int(opens.sum())
            a, b, c = _pair_counts(words, previous, place[:-1])
            # a pair's slice is that of both its words: the followers of a frequent word are spread
            own = slice_of(mix(a, b), slices)
            order = np.argsort(own, kind="stable")
            a, b, c, own = a[order], b[order], c[order], own[order]
            for kind, x, y, z, part in ((1, words, None, n, slice_of(words, slices)), (2, a, b, c, own)):
                borders = np.searchsorted(part, np.arange(slices + 1, dtype=np.uint64))
                for s in np.flatnonzero(np.diff(borders)):
                    low, high = borders[s], borders[s + 1]
                    rows.append(
                        (
                            int(s),
                            kind,
                            pack_sorted(x[low:high]),
                            planes(y[low:high]) if y is not None else b"",
                            planes(z[low:high].astype(np.uint64)),
                        )
                    )
            return pd.DataFrame(rows, columns=["slice", "kind", "first", "second", "counts"])

        for pdf in batches:
            texts = pdf["text"].tolist()
            for at, end in _text_groups(texts, 4 << 20):
                tokens, before, _ = _tokens(texts[at:end], cache)
                held.append((tokens, before))
                size += len(tokens)
                if size >= COUNT_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of one slice: ``words`` (hash, count), the keys of the filter (key, count, kind) and
    the slice's own contexts (``heads``) with their followers there."""
    lean()
    words = pdf[pdf["kind"] == 1]
    x = np.concatenate([unpack_sorted(f) for f in words["first"]] or [np.empty(0, np.uint64)])
    n = np.concatenate([unplanes(c, np.uint64) for c in words["counts"]] or [np.empty(0, np.uint64)])
    x, _, n = _summed(x, np.zeros_like(x), n.astype(np.int64))
    pairs = pdf[pdf["kind"] == 2]
    a = np.concatenate([unpack_sorted(f) for f in pairs["first"]] or [np.empty(0, np.uint64)])
    b = np.concatenate([unplanes(s, np.uint64) for s in pairs["second"]] or [np.empty(0, np.uint64)])
    c = np.concatenate([unplanes(c, np.uint64) for c in pairs["counts"]] or [np.empty(0, np.uint64)])
    a, b, c = _summed(a, b, c.astype(np.int64))
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] != a[:-1]
    starts = np.flatnonzero(new)
    keys = [_kind(x, _WORD), _kind(mix(a, b), _PAIR)]
    counts = [n, c]
    kinds = [np.full(len(k), i + 1, np.int8) for i, k in enumerate(keys)]
    known = x != _BEGIN
    return pd.DataFrame(
        {
            "slice": pdf["slice"].iloc[:1].to_numpy(),
            "words": [x[known].tobytes()],
            "word_counts": [n[known].astype(np.int64).tobytes()],
            "keys": [np.concatenate(keys).tobytes()],
            "counts": [np.concatenate(counts).astype(np.int64).tobytes()],
            "kinds": [np.concatenate(kinds).tobytes()],
            "heads": [pack_sorted(a[starts])],
            "followers": [planes(np.diff(np.append(starts, len(a))).astype(np.uint32))],
        }
    )


_KEY_SCHEMA = "slice int, words binary, word_counts binary, keys binary, counts binary, kinds binary"
_SLICE_SCHEMA = f"{_KEY_SCHEMA}, heads binary, followers binary"


def _deal_heads(slices: int):
    """Contexts of pair slices to slices by their own hash."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for heads, followers in zip(pdf["heads"], pdf["followers"]):
                x, n = unpack_sorted(heads), unplanes(followers, np.uint32)
                borders = cut(x, slices)
                own = np.flatnonzero(np.diff(borders))
                yield pd.DataFrame(
                    {
                        "slice": own.astype(np.int32),
                        "heads": [pack_sorted(x[borders[s] : borders[s + 1]]) for s in own],
                        "followers": [planes(n[borders[s] : borders[s + 1]]) for s in own],
                    }
                )

    return run


def _add_heads(pdf: pd.DataFrame) -> pd.DataFrame:
    """Keys of the contexts of one slice with their numbers of followers."""
    lean()
    x = np.concatenate([unpack_sorted(h) for h in pdf["heads"]])
    n = np.concatenate([unplanes(f, np.uint32) for f in pdf["followers"]]).astype(np.int64)
    x, _, n = _summed(x, np.zeros_like(x), n)
    return pd.DataFrame(
        {
            "slice": pdf["slice"].iloc[:1].to_numpy(),
            "words": [b""],
            "word_counts": [b""],
            "keys": [_kind(x, _MASS).tobytes()],
            "counts": [n.tobytes()],
            "kinds": [np.full(len(x), 3, np.int8).tobytes()],
        }
    )


@dataclass
class Model:
    """What scoring needs: the filter as a table (segment, bits), the frequent words, of bounded
    number, and a table (hash, count) of all others."""

    segments: int
    bits: DataFrame
    tokens: int
    distinct: int
    frequent: np.ndarray
    frequent_counts: np.ndarray
    rare: DataFrame


def _histogram(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for words, counts, kinds in zip(pdf["word_counts"], pdf["counts"], pdf["kinds"]):
            n = np.frombuffer(words, np.int64)
            kind = np.frombuffer(kinds, np.int8).astype(np.int64)
            level = level_of(np.frombuffer(counts, np.int64))
            code = np.concatenate([kind * 1000 + level, level_of(n)])
            values, times = np.unique(code, return_counts=True)
            yield pd.DataFrame(
                {"code": np.append(values, [-1, -2]), "n": np.append(times, [int(n.sum()), len(n)])}
            )


def train(rows: DataFrame, max_frequent: int = MAX_FREQUENT) -> Model:
    """Counts of ``rows (text)`` as a model."""
    spark = prepare(rows.sparkSession)
    slices = max(12, total_bytes(rows) // 6 // SLICE_ITEMS)
    added = (
        rows.select("text")
        .mapInPandas(_count(slices), _COUNT_SCHEMA)
        .repartition(slices, "slice")
        .groupBy("slice")
        .applyInPandas(_add_up, _SLICE_SCHEMA)
        .checkpoint()
    )
    heads = (
        added.select("heads", "followers")
        .mapInPandas(_deal_heads(slices), "slice int, heads binary, followers binary")
        .repartition(slices, "slice")
        .groupBy("slice")
        .applyInPandas(_add_heads, _KEY_SCHEMA)
        .checkpoint()
    )
    summed = added.drop("heads", "followers").unionByName(heads)
    histogram = {
        r["code"]: r["n"]
        for r in summed.mapInPandas(_histogram, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    }
    tokens, distinct = histogram.pop(-1, 0), histogram.pop(-2, 0)
    by_count = {code: n for code, n in histogram.items() if code < 1000}
    items = sum(n * (code % 1000) for code, n in histogram.items() if code >= 1000)
    segments = max(1, -(-items * BITS_PER_ITEM // SEGMENT_BITS))

    def inserts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, counts in zip(pdf["keys"], pdf["counts"]):
                key = np.frombuffer(keys, np.uint64)
                level = level_of(np.frombuffer(counts, np.int64)).astype(np.uint8)
                order, borders = _by_segment(key, segments)
                key, level = key[order], level[order]
                own = np.flatnonzero(np.diff(borders))
                yield pd.DataFrame(
                    {
                        "segment": own.astype(np.int32),
                        "keys": [key[borders[s] : borders[s + 1]].tobytes() for s in own],
                        "levels": [level[borders[s] : borders[s + 1]].tobytes() for s in own],
                    }
                )

    def set_bits(pdf: pd.DataFrame) -> pd.DataFrame:
        lean()
        bits = np.zeros(SEGMENT_BITS, dtype=bool)
        for keys, levels in zip(pdf["keys"], pdf["levels"]):
            key = np.frombuffer(keys, np.uint64)
            times = np.frombuffer(levels, np.uint8).astype(np.int64)
            each = np.repeat(np.arange(len(key)), times)
            level = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + 1
            _, at, stride = _spots(key[each], level, 1)
            for _ in range(PROBES):
                bits[at.astype(np.int64)] = True
                at = (at + stride) & np.uint64(SEGMENT_BITS - 1)
        return pd.DataFrame(
            {"segment": pdf["segment"].iloc[:1].to_numpy(), "bits": [np.packbits(bits, bitorder="little").tobytes()]}
        )

    bits = (
        summed.select("keys", "counts")
        .mapInPandas(inserts, "segment int, keys binary, levels binary")
        .repartition(segments, "segment")
        .groupBy("segment")
        .applyInPandas(set_bits, "segment int, bits binary")
    )

    least, so_far = max(by_count, default=0) + 1, 0
    while by_count.get(least - 1, 0) + so_far <= max_frequent and least > 1:
        least -= 1
        so_far += by_count.get(least, 0)

    def part(frequent: bool):
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for words, counts in zip(pdf["words"], pdf["word_counts"]):
                    n = np.frombuffer(counts, np.int64)
                    own = (level_of(n) >= least) == frequent
                    yield pd.DataFrame({"word": np.frombuffer(words, np.int64)[own], "n": n[own]})

        return run

    counted = added.select("words", "word_counts")
    top = counted.mapInPandas(part(True), "word long, n long").toPandas()
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return Model(
        segments, bits, tokens, distinct, words[order], top["n"].to_numpy(np.int64)[order],
        counted.mapInPandas(part(False), "word long, n long"),
    )


# --- scoring --------------------------------------------------------------------


_SCORED = pa.schema(
    [("key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
     ("score", pa.float64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
_SCORED_SCHEMA = "key long, n_tokens long, n_known long, base double, score double, words array<long>, times array<long>"


@dataclass
class _Texts:
    """Some texts as places in their vocabulary, and the keys of the filter that their scores need."""

    vocabulary: np.ndarray
    place: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.previous = np.empty_like(self.place)
        self.previous[1:] = self.place[:-1]
        self.previous[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.vocabulary, _BEGIN)
        codes, self.pair = np.unique(self.previous * len(self.vocabulary) + self.place, return_inverse=True)
        first, second = np.divmod(codes, len(self.vocabulary))
        words = self.vocabulary
        pairs = mix(words[first], words[second] >> _NEXT_BITS)
        self.keys = np.concatenate((_kind(words, _WORD), _kind(words, _MASS), _kind(pairs, _PAIR)))


def _texts(texts: list[str], cache: WordHash) -> _Texts:
    tokens, _, sizes = _tokens(texts, cache)
    vocabulary, place = np.unique(np.append(tokens, _BEGIN), return_inverse=True)
    return _Texts(vocabulary, place[:-1], sizes)


def _scores(t: _Texts, levels: np.ndarray, keys: pa.Array, frequent, frequent_counts, scale) -> pa.RecordBatch:
    """One row per text, from the levels of ``t.keys`` in the filter."""
    vocabulary, place, sizes = t.vocabulary, t.place, t.sizes
    v, n = len(vocabulary), len(sizes)
    docs = np.repeat(np.arange(n), sizes)
    # exact counts of frequent words
    found = np.minimum(np.searchsorted(frequent, vocabulary), max(0, len(frequent) - 1))
    known = frequent[found] == vocabulary if len(frequent) else np.zeros(v, bool)
    exact = np.where(known, frequent_counts[found], 0) if len(frequent) else np.zeros(v)
    base = np.log10((exact + ADD) / scale)
    # the model: quantised counts from the filter
    values = value_of(levels)
    count, mass, pairs = values[:v], DISCOUNT * values[v : 2 * v], values[2 * v :][t.pair]
    unigram = (count + ADD) / scale
    context, backed = count[t.previous], mass[t.previous]
    share = np.where((backed > 0) & (context > 0), np.minimum(1.0, backed / np.maximum(context, 1)), 1.0)
    direct = np.where(context > 0, np.maximum(pairs - DISCOUNT, 0) / np.maximum(context, 1), 0.0)
    p = np.minimum(1.0, np.where(share < 1, direct, 0.0) + share * unigram[place])
    rare = ~known[place]
    owner, word, times = _summed(docs[rare], vocabulary[place[rare]], np.ones(int(rare.sum()), np.int64))
    cuts = np.searchsorted(owner, np.arange(1, n))
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array(sizes),
            pa.array(np.bincount(docs, known[place], n).astype(np.int64)),
            pa.array(np.bincount(docs, base[place], n)),
            pa.array(np.bincount(docs, np.log10(p), n)),
            pa.array(np.split(word.view(np.int64), cuts), pa.list_(pa.int64())),
            pa.array(np.split(times, cuts), pa.list_(pa.int64())),
        ],
        schema=_SCORED,
    )


def _score(shared, scale: float):
    """Scores with the whole filter at hand."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        bits, frequent, frequent_counts = shared.value
        held, cache = Filter(bits), WordHash()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, end in _text_groups(texts, 6 * SCORE_TOKENS):
                t = _texts(texts[at:end], cache)
                keys = batch.column(0).slice(at, end - at)
                yield _scores(t, held.levels(t.keys), keys, frequent, frequent_counts, scale)

    return run


_ASKED_SCHEMA = "batch long, segment int, data binary, keys binary, sizes binary, words binary"


def _ask(segments: int):
    """Batches of texts (segment -1) and the keys that each asks of each segment."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        cache, number = WordHash(), TaskContext.get().partitionId() << 40
        for pdf in batches:
            texts, keys = pdf["text"].tolist(), pdf["key"].to_numpy(np.int64)
            for at, end in _text_groups(texts, 6 * SCORE_TOKENS):
                t = _texts(texts[at:end], cache)
                rows = [
                    (number, -1, planes(t.place.astype(np.uint32)), keys[at:end].tobytes(), planes(t.sizes),
                     pack_sorted(t.vocabulary))
                ]
                order, borders = _by_segment(t.keys, segments)
                asked = t.keys[order]
                for s in np.flatnonzero(np.diff(borders)):
                    rows.append((number, int(s), asked[borders[s] : borders[s + 1]].tobytes(), None, None, None))
                yield pd.DataFrame(rows, columns=["batch", "segment", "data", "keys", "sizes", "words"])
                number += 1

    return run


def _answer(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Levels of the keys asked; rows come by segment, its bits (batch -1) first."""
    lean()
    held, own = Filter(np.empty(0, np.uint8)), -1
    for pdf in batches:
        rows = []
        for batch, segment, data in zip(pdf["batch"], pdf["segment"], pdf["data"]):
            if segment != own:  # a segment without bits holds nothing
                held, own = Filter(np.frombuffer(data if batch < 0 else b"", np.uint8)), segment
            if batch >= 0:
                rows.append((batch, segment, held.levels(np.frombuffer(data, np.uint64)).astype(np.uint8).tobytes()))
        yield pd.DataFrame(rows, columns=["batch", "segment", "data"])


def _score_answers(shared, scale: float, segments: int):
    """Scores of batches; rows come by batch, its texts (segment -1) before the answers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        frequent, frequent_counts = shared.value
        t = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] >= 0:
                    s = row["segment"]
                    levels[order[borders[s] : borders[s + 1]]] = np.frombuffer(row["data"], np.uint8)
                    continue
                if t is not None:
                    yield _scores(t, levels, keys, frequent, frequent_counts, scale)
                place = unplanes(row["data"], np.uint32).astype(np.int64)
                t = _Texts(unpack_sorted(row["words"]), place, unplanes(row["sizes"], np.int64))
                keys = pa.array(np.frombuffer(row["keys"], np.int64))
                order, borders = _by_segment(t.keys, segments)
                levels = np.zeros(len(t.keys), np.int64)
        if t is not None:
            yield _scores(t, levels, keys, frequent, frequent_counts, scale)

    return run


def _scored(rows: DataFrame, model: Model, scale: float, max_filter_bytes: int) -> DataFrame:
    """Scores of ``rows (key, text)``, without the base scores of rare words."""
    context = rows.sparkSession.sparkContext
    size, segments = SEGMENT_BITS // 8, model.segments
    if segments * size <= max_filter_bytes:
        bits = np.zeros(segments * size, np.uint8)
        for r in model.bits.toLocalIterator():
            bits[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        shared = context.broadcast((bits, model.frequent, model.frequent_counts))
        return rows.mapInArrow(_score(shared, scale), _SCORED_SCHEMA)
    shared = context.broadcast((model.frequent, model.frequent_counts))
    sent = stage(rows.mapInPandas(_ask(segments), _ASKED_SCHEMA))
    asked = sent.filter("segment >= 0").select("batch", "segment", "data")
    bits = model.bits.select(F.lit(-1).cast("long").alias("batch"), "segment", F.col("bits").alias("data"))
    answered = (
        asked.unionByName(bits)
        .repartition(max(12, segments // 8), "segment")
        .sortWithinPartitions("segment", "batch")
        .mapInPandas(_answer, "batch long, segment int, data binary")
    )
    return (
        sent.filter("segment < 0")
        .unionByName(answered, allowMissingColumns=True)
        .repartition("batch")
        .sortWithinPartitions("batch", "segment")
        .mapInArrow(_score_answers(shared, scale, segments), _SCORED_SCHEMA)
    )


def lm_scores(
    docs: DataFrame,
    held_out: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_filter_bytes: int = MAX_FILTER_BYTES,
    max_frequent: int = MAX_FREQUENT,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` (over ``doc_id``) are the rows that are not learned from; by
    default those whose crc32(id as text) mod 10 is 0.  A filter of more than
    ``max_filter_bytes`` is not broadcast.
    """
    prepare(docs.sparkSession)
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    rows = keyed(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = train(rows.filter(~F.col("held_out")), max_frequent)
    scale = model.tokens + ADD * (model.distinct + 1)
    unknown = np.log10(ADD / scale)
    scored = _scored(rows.select("key", "text"), model, scale, max_filter_bytes).checkpoint()
    rare = (
        scored.select("key", F.explode(F.arrays_zip("words", "times")).alias("w"))
        .select("key", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
        .join(model.rare, "word")
        .groupBy("key")
        .agg(
            F.sum("times").alias("more"),
            F.sum(F.col("times") * (F.log10((F.col("n") + ADD) / scale) - unknown)).alias("gain"),
        )
    )
    return (
        rows.select("key", "doc_id", "held_out")
        .join(scored.drop("words", "times"), "key")
        .join(rare, "key", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
            "score",
        )
    )


ship_by_value(__name__)
