"""Substring dedup with fixed-block anchors, on words.

A passage is a run of ``WINDOW`` words.  Each document's non-overlapping
blocks of ``(WINDOW + 1) // 2`` words are the reference index: any passage
holds at least one whole block of its own document.  Every rolling window of
block length of every document probes the index.  Where a document hits a
block of a document with a smaller id, the hit is extended: all passages
around it, on both sides, are compared in full, and a passage whose words
also start in a document with a smaller id is covered.  Overlapping covered
passages join to maximal exact repeats, which are removed.

Probes and blocks meet in slices of the hash space.  A task sends its sorted
hashes as one binary value per slice, so a passage that very many documents
share is one small entry per document, spread over slices; no pairs of
documents are formed.  A slice holds about ``SLICE_ITEMS`` entries.  Anchors
are 48-bit hashes (a false one costs a comparison, no result); passages are
compared by 64-bit hashes of their words.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Ids must be integers.

Defined cases: null and empty texts have no words; a row with a null id is
behind all others, and rows with equal ids (repeated rows too) do not remove
each other's passages; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import (
    ENTRY_SCHEMA,
    WordHash,
    entries,
    gathered,
    keyed,
    lean,
    planes,
    rolling,
    run_starts,
    slices_for,
    total_bytes,
    unplanes,
    windows,
    word_arrays,
)
from tagweave.workers import ship_by_value

WINDOW = 50
ANCHOR_BITS = 48
SLICE_ITEMS = 1_500_000
#: Words that a task sorts at a time.
CHUNK_WORDS = 1_000_000
_LAST = np.iinfo(np.int64).max

def _anchor(hashes: np.ndarray) -> np.ndarray:
    return hashes & ~np.uint64((1 << (64 - ANCHOR_BITS)) - 1)


def _probe(block: int, slices: int):
    """Every rolling block of the texts; ``extra`` is 1 for reference blocks."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        cache = WordHash()
        held, size = [], 0

        def flush() -> pd.DataFrame:
            counts = np.concatenate([c for _, c, _, _ in held])
            hashes = np.concatenate([h for h, _, _, _ in held])
            keys = np.concatenate([k for _, _, k, _ in held])
            ranks = np.concatenate([r for _, _, _, r in held])
            held.clear()
            at, owner = windows(counts, block)
            aligned = (at - run_starts(counts)[owner]) % block == 0
            return entries(_anchor(rolling(hashes, block)[at]) if len(at) else hashes[:0], owner, aligned, keys, ranks, slices)

        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                hashes, counts = word_arrays(part["text"], cache)
                held.append((hashes, counts, part["key"].to_numpy(np.int64), part["rank"].to_numpy(np.int64)))
                size += len(hashes)
                if size >= CHUNK_WORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _hits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Anchors of one slice: blocks hit from a larger id, and windows that hit a smaller one."""
    lean()
    h, key, rank, aligned, starts, group, _ = gathered(pdf)
    aligned = aligned > 0
    least = np.minimum.reduceat(np.where(aligned, rank, _LAST), starts)[group]
    most = np.maximum.reduceat(rank, starts)[group]
    probe, block = rank > least, aligned & (rank < most)
    out = pd.DataFrame(
        {
            "key": np.concatenate([key[probe], key[block]]),
            "anchor": np.concatenate([h[probe], h[block]]).view(np.int64),
            "block": np.repeat([False, True], [probe.sum(), block.sum()]),
        }
    )
    return out.drop_duplicates()


def _extend(window: int, block: int, slices: int):
    """Hashes of all passages around the hits of each text; ``extra`` is the passage's start."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        cache = WordHash()
        for number, pdf in enumerate(batches):
            batch = (TaskContext.get().partitionId() << 32) + number
            found, owner, start = [], [], []
            for place, (text, probes, blocks) in enumerate(zip(pdf["text"], pdf["probes"], pdf["blocks"])):
                hashes, _ = word_arrays([text], cache)
                passages = len(hashes) - window + 1
                if passages <= 0:
                    continue
                small = _anchor(rolling(hashes, block))
                marked = np.isin(small, np.asarray(probes, np.int64).view(np.uint64))
                own = np.arange(0, len(small), block)
                marked[own] |= np.isin(small[own], np.asarray(blocks, np.int64).view(np.uint64))
                # passage s holds the block at q if s <= q <= s + window - block
                before = np.concatenate(([0], np.cumsum(marked)))
                s = np.arange(passages)
                s = s[before[s + window - block + 1] > before[s]]
                found.append(rolling(hashes, window)[s])
                owner.append(np.full(len(s), place))
                start.append(s)
            if found:
                yield entries(
                    np.concatenate(found), np.concatenate(owner), np.concatenate(start),
                    pdf["key"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64), slices, batch,
                )

    return run


def _covered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one slice: passages that also start under a smaller id, one row per batch they came in."""
    lean()
    _, key, rank, start, starts, group, source = gathered(pdf)
    late = np.flatnonzero(rank > np.minimum.reduceat(rank, starts)[group])
    batch = pdf["batch"].to_numpy()[source[late]]
    order = np.argsort(batch, kind="stable")
    late, batch = late[order], batch[order]
    numbers, at = np.unique(batch, return_index=True)
    parts = np.split(late, at[1:]) if len(numbers) else []
    return pd.DataFrame(
        {
            "batch": numbers,
            "keys": [planes(key[p]) for p in parts],
            "starts": [planes(start[p]) for p in parts],
        }
    )


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """The covered starts of one batch, one row per document."""
    key = np.concatenate([unplanes(k, np.int64) for k in pdf["keys"]])
    start = np.concatenate([unplanes(s, np.uint32) for s in pdf["starts"]]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    keys, at = np.unique(key[order], return_index=True)
    return pd.DataFrame({"key": keys, "starts": [x.tobytes() for x in np.split(start[order], at[1:])]})


def _cut(window: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, sizes = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode("utf-8", "replace").split()
                sizes.append(len(words))
                own = []
                if starts:
                    at = np.sort(np.concatenate([np.frombuffer(s, np.int64) for s in starts]))
                    gap = np.flatnonzero(at[1:] > at[:-1] + window)
                    own = list(zip(at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + window).tolist()))
                    words = [w for a, b in zip([0, *(e for _, e in own)], [*(s for s, _ in own), len(words)]) for w in words[a:b]]
                kept.append(b" ".join(words).decode("utf-8", "replace"))
                removed.append([{"start": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, spans)],
                names=["doc_id", "text", "n_words", "removed"],
            )

    return run


def drop_repeated_passages(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, text (kept words joined by one space), n_words, and
    removed, the maximal repeats as ranges of words."""
    block = (window + 1) // 2
    rows = keyed(docs, id_col, text_col).withColumn("rank", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    slices = slices_for(total_bytes(rows) // 6, SLICE_ITEMS)
    anchors = (
        rows.select("key", "rank", "text")
        .mapInPandas(_probe(block, slices), ENTRY_SCHEMA)
        .groupBy("slice")
        .applyInPandas(_hits, "key long, anchor long, block boolean")
        .checkpoint()
    )
    hits = anchors.groupBy("key").agg(
        F.collect_list(F.when(~F.col("block"), F.col("anchor"))).alias("probes"),
        F.collect_list(F.when(F.col("block"), F.col("anchor"))).alias("blocks"),
    )
    covered = (
        rows.join(hits, "key")
        .select("key", "rank", "text", "probes", "blocks")
        .mapInPandas(_extend(window, block, slices), ENTRY_SCHEMA)
        .groupBy("slice")
        .applyInPandas(_covered, "batch long, keys binary, starts binary")
        .groupBy("batch")
        .applyInPandas(_by_document, "key long, starts binary")
        .checkpoint()
    )
    by_doc = covered.groupBy("key").agg(F.collect_list("starts").alias("starts"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (
        rows.select("key", "doc_id", "text")
        .join(by_doc, "key", "left")
        .select("doc_id", "text", "starts")
        .mapInArrow(
            _cut(window),
            f"doc_id {kind}, text string, n_words long, removed array<struct<start: bigint, end: bigint>>",
        )
    )


ship_by_value(__name__)
