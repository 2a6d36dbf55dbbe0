"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

A string is ``LENGTH`` bytes.  Strings are dealt to shards by their minimizer,
the byte gram of smallest hash inside them, so equal strings are in one shard
whatever documents they stand in.  Minimizers that occur once cannot belong
to a repeated string; only text around repeated ones travels, as chunks that
hold all strings of one minimizer occurrence.  Equal chunks are one chunk
with a count.

Each shard joins its distinct chunks and builds their suffix array by
Larsson-Sadakane refinement (sort by five bytes, then refine only groups that
are not yet told apart by doubling ranks) and the common prefixes of
neighbours by Kasai's bound.  A run of neighbours that share ``LENGTH`` bytes
is one string; with two or more starts in it, all of them are repeated.

The chunks of a minimizer with more than ``SPLIT`` occurrences are dealt over
several shards.  Those shards also send their sorted string hashes, cut into
ranges, and each range is merged by binary search of every shard's run in
what has been merged before, which finds strings that two shards share.
Thus no shard grows with the size of a group.

Minimizers and merged strings are compared by 64-bit hashes, chunks by 128
bits; strings within a shard by their bytes.

Defined cases: null and empty texts have no bytes; every row is a document of
its own, so repeated rows remove each other whole if long enough; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import (
    ENTRY_SCHEMA,
    entries,
    gathered,
    keyed,
    lean,
    mix,
    rolling,
    run_starts,
    slices_for,
    stage,
    total_bytes,
    unpack_sorted,
    unplanes,
    windows,
)
from tagweave.workers import ship_by_value

LENGTH = 200
#: Bytes of a minimizer gram, as a share of the length.
GRAM_SHARE = 0.24
#: Occurrences of a minimizer that stay in one shard, and chunks per shard.
SPLIT = 2048
SHARD_CHUNKS = 4096
#: Minimizers that one task counts together.
GRAM_SLICE = 300_000
#: Bytes whose minimizers a task looks for at a time; places in them take 24 bits.
PIECE = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)


def minimizers(pieces: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one minimizer occurrence: its hash, the piece,
    the first start in the piece, and the number of starts.

    Grams are minimizers because their hashes are small, so those would nearly all lie in
    the first slice.  Mixed once more (one to one) they spread over all 64 bits."""
    counts = np.array([len(p) for p in pieces], dtype=np.int64)
    starts, owner = windows(counts, length)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    hashes = rolling(mix(text, np.uint64(0x9E3779B9)), gram)
    span = length - gram + 1
    code = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(code) // span) * span + span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(code)] = code
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(behind[starts], ahead[starts + span - 1]) & _PLACE).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    number = np.diff(np.append(at, len(starts)))
    first = starts[at] - run_starts(counts)[owner[at]]
    return mix(hashes[place[at]], np.uint64(0)), owner[at], first, number


def _pieces(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a long text that share ``length - 1`` bytes, so each start is in one part."""
    at = 0
    while True:
        yield at, data[at : at + PIECE + length - 1]
        at += PIECE
        if at + length > len(data):
            return


def _groups(texts: Iterable[str], length: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Pieces of many texts, the text of each and its offset there."""
    held, owner, offset, size = [], [], [], 0
    for number, text in enumerate(texts):
        for at, piece in _pieces(text.encode("utf-8", "replace"), length):
            if size + len(piece) > PIECE + length and held:
                yield held, owner, offset
                held, owner, offset, size = [], [], [], 0
            held.append(piece)
            owner.append(number)
            offset.append(at)
            size += len(piece)
    if held:
        yield held, owner, offset


def _occurrences(length: int, gram: int, slices: int):
    """Each document's minimizers; ``extra`` is how often one occurs in the document."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        held, size = [], 0

        def flush() -> pd.DataFrame:
            hashes, owner, times = (np.concatenate(x) for x in zip(*(x[:3] for x in held)))
            first = np.repeat(run_starts(np.array([len(x[3]) for x in held])), [len(x[0]) for x in held])
            keys = np.concatenate([x[3] for x in held])
            held.clear()
            return entries(hashes, owner + first, times, keys, keys, slices)

        for pdf in batches:
            for pieces, owner, _ in _groups(pdf["text"], length):
                hashes, piece, _, _ = minimizers(pieces, length, gram)
                owner, place = np.unique(np.array(owner), return_inverse=True)
                held.append((*_counted(hashes, place[piece]), pdf["key"].to_numpy(np.int64)[owner]))
                size += len(held[-1][0])
                if size >= GRAM_SLICE:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of hash and owner (in ascending order), and how often each occurs."""
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Minimizers that occur twice or more: each document's, with the number of occurrences."""
    lean()
    h, key, _, times, starts, group, _ = gathered(pdf)
    times = np.add.reduceat(times.astype(np.int64), starts)[group]
    often = times > 1
    return pd.DataFrame(
        {"key": key[often], "gram": h[often].view(np.int64), "n": times[often]}
    ).drop_duplicates()


_CHUNK_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("split", pa.bool_()), ("digest", pa.binary()), ("chunk", pa.binary()),
     ("key", pa.int64()), ("start", pa.int64()), ("starts", pa.int32())]
)


def _chunks(length: int, gram: int, shards: int):
    """Chunks around repeated minimizers; a chunk's bytes are sent once by each task.

    A minimizer's number of occurrences is that of the whole input, so the lists of a
    batch's documents are one list, and their texts are gone through together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        sent: set[bytes] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            known, at = np.unique(batch.column(2).flatten().to_numpy().view(np.uint64), return_index=True)
            times = batch.column(3).flatten().to_numpy()[at]
            for pieces, owner, offset in _groups(batch.column(1).to_pylist(), length):
                hashes, piece, first, number = minimizers(pieces, length, gram)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == hashes)
                piece, first, number = piece[hit], first[hit], number[hit]
                digests, fresh = [], []
                for p, a, b in zip(piece.tolist(), first.tolist(), (first + number + (length - 1)).tolist()):
                    chunk = pieces[p][a:b]
                    digest = xxhash.xxh3_128_digest(chunk)
                    digests.append(digest)
                    fresh.append(None if digest in sent else chunk)
                    sent.add(digest)
                if not digests:
                    continue
                parts = -(-times[at[hit]] // SPLIT)
                salt = np.frombuffer(b"".join(digests), "<u4")[::4] % parts
                shard = [
                    xxhash.xxh64_intdigest(h + s) % shards
                    for h, s in zip(_each(hashes[hit].astype("<u8")), _each(salt.astype("<u4")))
                ]
                columns = [
                    shard, parts > 1, digests, fresh,
                    keys[np.array(owner)[piece]], np.array(offset)[piece] + first, number.astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _CHUNK_SCHEMA)], schema=_CHUNK_SCHEMA
                )

    return run


def _each(values: np.ndarray) -> list[bytes]:
    """Each number's bytes."""
    data, width = values.tobytes(), values.dtype.itemsize
    return [data[at : at + width] for at in range(0, len(data), width)]


# --- suffix arrays ----------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number (zeros past the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _sorted_places(code: np.ndarray, bits: int) -> np.ndarray:
    """Places of ``code`` (below ``2**bits``) in ascending order.  If code and place fit in
    one 64-bit word, plain words are sorted, which is several times faster."""
    own = max(1, (len(code) - 1).bit_length())
    if bits + own > 64:
        return np.argsort(code, kind="stable")
    word = (code.astype(np.uint64) << np.uint64(own)) | np.arange(len(code), dtype=np.uint64)
    word.sort()
    return (word & np.uint64((1 << own) - 1)).astype(np.int64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes or more.

    Larsson-Sadakane: a suffix's rank is its group's first slot; only groups of
    two or more are refined, by the rank of the suffix ``h`` places on, and
    ``h`` doubles.
    """
    n = len(text)
    h = 5
    first = _words(text) >> np.uint64(64 - 8 * h)
    order = _sorted_places(first, 8 * h)
    sorted_ = first[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    slots = np.flatnonzero(new)
    size = np.diff(np.append(slots, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(slots, size)
    rank[n] = -1
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # slots in groups of two or more
    bits = ((n + 2) * (n + 2)).bit_length()
    while h < depth and len(open_):
        at = order[open_]
        code = rank[at] * (n + 2) + rank[np.minimum(at + h, n)] + 1
        by = _sorted_places(code, bits)
        at, code = at[by], code[by]
        order[open_] = at
        new = np.ones(len(at), dtype=bool)
        new[1:] = code[1:] != code[:-1]
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(at)))
        rank[at] = np.repeat(open_[heads], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int, step: int = 8) -> np.ndarray:
    """For each slot, the bytes its suffix shares with the slot before (at most ``cap``).

    Kasai's bound - the suffix one place on shares one byte less at least -
    carried through ``step`` passes over every ``step``-th place, so that each
    pass is one vector operation and starts where the bound leaves off.  At the
    cap the order of two suffixes may be open, so there the bound holds only if
    the next suffix follows the same neighbour.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.concatenate([_words(text), np.zeros(cap + 16, np.uint64)])
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    shared = np.zeros(n + 1, np.int64)
    for phase in range(step):
        place = np.arange(phase, n, step)
        place = place[before[place] >= 0]
        other = before[place]
        bound = np.zeros(len(place), np.int64)
        if phase:
            last = shared[place - 1]
            sound = (last < cap) | (other == before[place - 1] + 1)
            bound = np.where(sound, np.maximum(last - 1, 0), 0)
        size = np.minimum(bound, cap)
        live = np.flatnonzero(size < cap)
        while len(live):  # whole words first
            a, b = place[live] + size[live], other[live] + size[live]
            same = words[np.minimum(a, n)] == words[np.minimum(b, n)]
            same &= (a + 8 <= n) & (b + 8 <= n)
            size[live[same]] += 8
            live = live[same]
            live = live[size[live] < cap]
        live = np.flatnonzero(size < cap)
        for _ in range(7):  # then the rest of a word
            a, b = place[live] + size[live], other[live] + size[live]
            same = (padded[a] == padded[b]) & (a < n) & (b < n)
            live = live[same]
            size[live] += 1
            if not len(live):
                break
        shared[place] = np.minimum(size, cap)
    return shared[order]


def _shard(length: int, slices: int):
    columns = ["digest", "flags", "hashes", "owner", "extra", "keys", "ranks", "slice"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lean()
        pdf = pdf.drop_duplicates("digest")
        chunks = pdf["chunk"].tolist()
        size = np.array([len(c) for c in chunks], dtype=np.int64)
        offset = run_starts(size)
        text = np.frombuffer(b"".join(chunks), np.uint8)
        inner, chunk_of = windows(size, length)
        start = np.zeros(len(text), dtype=bool)
        start[inner] = True
        order = suffix_array(text, length)
        shared = common_prefixes(text, order, length)
        run_of = np.cumsum(shared < length) - 1
        each = np.bincount(run_of, start[order])
        twice = np.zeros(len(text), dtype=bool)
        twice[order] = each[run_of] > 1
        repeated = twice & start
        rows = []
        for k in np.flatnonzero(np.bincount(chunk_of, repeated[inner], len(chunks))):
            flags = repeated[offset[k] : offset[k] + size[k] - length + 1]
            rows.append((pdf["digest"].iloc[k], np.packbits(flags).tobytes(), *[None] * 5, -1))
        out = [pd.DataFrame(rows, columns=columns)]
        split = pdf["split"].to_numpy(dtype=bool)
        if split.any():  # the strings of split minimizers, for the merge with other shards
            own = split[chunk_of]
            hashes = rolling(mix(text.astype(np.uint64), np.uint64(7)), length)[inner[own]]
            halves = np.array([np.frombuffer(d, np.int64) for d in pdf["digest"]])
            sent = entries(
                hashes, chunk_of[own], inner[own] - offset[chunk_of[own]], halves[:, 0].copy(), halves[:, 1].copy(), slices
            )
            out.append(sent.assign(digest=None, flags=None)[columns])
        return pd.concat(out, ignore_index=True)

    return run


_SHARD_SCHEMA = (
    "digest binary, flags binary, hashes binary, owner binary, extra binary, keys binary, ranks binary, slice int"
)


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Values that are in two or more of the ascending ``runs``, by binary search of
    each run in the merged values of those before it."""
    merged, twice = np.empty(0, np.uint64), []
    for run in runs:
        own = np.unique(run)
        if len(merged):
            at = np.searchsorted(merged, own)
            hit = merged[np.minimum(at, len(merged) - 1)] == own
            twice.append(own[hit])
            fresh = own[~hit]
            merged = np.insert(merged, np.searchsorted(merged, fresh), fresh)
        else:
            merged = own
    return np.unique(np.concatenate(twice)) if twice else np.empty(0, np.uint64)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings of one range that two shards share: the starts of each chunk that has them,
    one row a chunk with its starts packed."""
    runs = [unpack_sorted(h) for h in pdf["hashes"]]
    both = merge_runs(runs)
    found: dict[bytes, list[np.ndarray]] = {}
    for run, o, e, k, r in zip(runs, pdf["owner"], pdf["extra"], pdf["keys"], pdf["ranks"]):
        if not len(both):
            break
        hit = both[np.minimum(np.searchsorted(both, run), len(both) - 1)] == run
        place, start = unplanes(o, np.uint32)[hit], unplanes(e, np.uint32)[hit].astype(np.int32)
        halves = np.column_stack([unplanes(k, np.int64), unplanes(r, np.int64)])
        order = np.argsort(place, kind="stable")
        used, first = np.unique(place[order], return_index=True)
        for p, own in zip(used, np.split(start[order], first[1:])):
            found.setdefault(halves[p].tobytes(), []).append(own)
    packed = [np.concatenate(x).tobytes() for x in found.values()]
    return pd.DataFrame({"digest": list(found), "starts": packed})


# --- removal ------------------------------------------------------------------------


def _repeats(found: pa.StructArray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of runs of repeated starts, in no order; ``first`` is the place of
    each chunk's first start."""
    starts, copies, flags, merged = (found.field(k) for k in ("starts", "copies", "flags", "merged"))
    whole = copies.to_numpy() > 1
    low, high = [first[whole]], [(first + starts.to_numpy() - 1)[whole]]
    own = np.flatnonzero(~whole & flags.is_valid().to_numpy(zero_copy_only=False))
    packed = flags.take(pa.array(own)).to_pylist()
    places = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(packed), np.uint8)))
    begin = run_starts(np.array([8 * len(x) for x in packed], dtype=np.int64))
    if len(places):
        chunk = np.searchsorted(begin, places, side="right") - 1
        places += first[own[chunk]] - begin[chunk]
        gap = np.flatnonzero(np.diff(places) != 1)
        low.append(places[np.append(0, gap + 1)])
        high.append(places[np.append(gap, len(places) - 1)])
    own = np.flatnonzero(~whole & merged.is_valid().to_numpy(zero_copy_only=False))
    for k, lists in zip(own.tolist(), merged.take(pa.array(own)).to_pylist()):
        at = first[k] + np.frombuffer(b"".join(lists), np.int32)
        low.append(at)
        high.append(at)
    return np.concatenate(low), np.concatenate(high)


def _cut(length: int):
    spans = ["start", "end"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            kept = [text.encode("utf-8", "replace") for text in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in kept], dtype=np.int64)
            found = batch.column(2)
            chunks = found.value_lengths().fill_null(0).to_numpy()
            # Documents lie more than a string apart, so runs of two of them never meet.
            base = run_starts(sizes + length + 1)
            rows = found.flatten()
            low, high = _repeats(rows, np.repeat(base, chunks) + rows.field("start").to_numpy())
            order = np.argsort(low)
            low, high = low[order], np.maximum.accumulate(high[order])
            gap = np.flatnonzero(low[1:] > high[:-1] + length)
            if len(low):
                low, high = low[np.append(0, gap + 1)], high[np.append(gap, len(high) - 1)] + length
            borders = np.searchsorted(low, np.append(base, np.iinfo(np.int64).max))
            owner = np.repeat(np.arange(len(kept)), np.diff(borders))
            low, high = low - base[owner], high - base[owner]
            for k in np.unique(owner).tolist():
                own = slice(borders[k], borders[k + 1])
                kept[k] = b"".join(
                    kept[k][a:b] for a, b in zip([0, *high[own].tolist()], [*low[own].tolist(), len(kept[k])])
                )
            removed = pa.ListArray.from_arrays(
                pa.array(borders, pa.int32()), pa.StructArray.from_arrays([pa.array(low), pa.array(high)], spans)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes), removed],
                names=["doc_id", "kept", "n_bytes", "removed"],
            )

    return run


def drop_repeated_strings(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, kept (bytes), n_bytes, and removed, the ranges of
    bytes that repeated strings cover."""
    gram = max(1, int(length * GRAM_SHARE))
    rows = keyed(docs, id_col, text_col)
    size = total_bytes(rows)
    slices = slices_for(size * 2 // (length - gram + 1), GRAM_SLICE)
    grams = (
        rows.select("key", "text")
        .mapInPandas(_occurrences(length, gram, slices), ENTRY_SCHEMA)
        .groupBy("slice")
        .applyInPandas(_repeated, "key long, gram long, n long")
        .checkpoint()
    )
    shards = max(12, grams.count() // SHARD_CHUNKS)
    by_doc = grams.groupBy("key").agg(F.collect_list(F.struct("gram", "n")).alias("g"))
    chunks = stage(
        rows.select("key", "text")
        .join(by_doc, "key")
        .select("key", "text", "g.gram", "g.n")
        .mapInArrow(
            _chunks(length, gram, shards),
            "shard int, split boolean, digest binary, chunk binary, key long, start long, starts int",
        )
    )
    found = (
        chunks.filter("chunk is not null")
        .select("shard", "split", "digest", "chunk")
        .groupBy("shard")
        .applyInPandas(_shard(length, slices), _SHARD_SCHEMA)
        .checkpoint()
    )
    merged = (
        found.filter("slice >= 0")
        .select("slice", "hashes", "owner", "extra", "keys", "ranks")
        .groupBy("slice")
        .applyInPandas(_merge, "digest binary, starts binary")
        .groupBy("digest")
        .agg(F.collect_list("starts").alias("merged"))
    )
    per_chunk = (
        chunks.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(found.filter("slice < 0").select("digest", "flags"), "digest", "left")
        .join(merged, "digest", "left")
        .filter("copies > 1 or flags is not null or merged is not null")
        .checkpoint()
    )
    spans = (
        chunks.select("digest", "key", "start", "starts")
        .join(per_chunk, "digest")
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "starts", "copies", "flags", "merged")).alias("found"))
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (
        rows.select("key", "doc_id", "text")
        .join(spans, "key", "left")
        .select("doc_id", "text", "found")
        .mapInArrow(
            _cut(length),
            f"doc_id {kind}, kept binary, n_bytes long, removed array<struct<start: bigint, end: bigint>>",
        )
    )


ship_by_value(__name__)
