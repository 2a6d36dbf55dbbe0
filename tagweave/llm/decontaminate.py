"""Benchmark decontamination: short test items found inside long documents.

Containment search after the LSH-ensemble idea: items are partitioned by the
size of their shingle sets, and each partition has a MinHash sketch length
that suits its sizes.  An item's sketch is its ``k`` shingles of smallest
hash (bottom-k MinHash), with ``k = floor((1 - threshold) * upper) + 1`` for
sizes up to ``upper`` in its partition: a document that holds at least the
threshold's share of an item's shingles lacks fewer than ``k`` of them, so
one of the sketch is in the document and no item is missed.  The document
side does not depend on its length - every shingle of the whole text probes
the index.  Candidates are verified by the words of their shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z folded and ASCII punctuation
deleted.  Shingles have five words; an item of fewer words is one shingle.

Items are indexed in blocks of at most ``BLOCK_ITEM_BYTES`` of text (one
block here), each broadcast and held against all documents in one pass
without a shuffle, so the broadcast is bounded however many items there are.

Defined cases: null and empty items or items without words are in no
document; null and empty documents hold nothing; equal rows of items count
once; repeated rows and null ids of documents are searched row by row; an
empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tagweave.llm.common import WordHash, lean, prepare, rolling, run_starts, word_arrays
from tagweave.workers import ship_by_value

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_ITEM_BYTES = 32 << 20
_PUNCTUATION = string.punctuation.encode()
_TABLE_BITS = 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(None, _PUNCTUATION).split()


def sketch_length(size: int, threshold: float) -> int:
    """Sketch length of the partition (sizes up to a power of two) that ``size`` is in."""
    upper = 1 << max(0, size - 1).bit_length()
    return min(size, int((1 - threshold) * upper + 1e-9) + 1)


class ItemIndex:
    """Sketches of a block of items, and the search of texts against them."""

    def __init__(self, items: list[str], threshold: float = THRESHOLD, shingle: int = SHINGLE):
        self.threshold, self.cache = threshold, WordHash()
        self.sets: list[dict[int, tuple]] = []
        by_width: dict[int, list[tuple[int, int]]] = {}
        self.width_of: list[int] = []
        for number, text in enumerate(items):
            words = words_of(text or "")
            width = min(shingle, len(words))
            own: dict[int, tuple] = {}
            if words:
                hashes = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
                for at, h in enumerate(rolling(hashes, width).tolist()):
                    own[h] = tuple(words[at : at + width])
                for h in sorted(own)[: sketch_length(len(own), threshold)]:
                    by_width.setdefault(width, []).append((h, number))
            self.sets.append(own)
            self.width_of.append(width)
        self.index = {}
        for width, pairs in by_width.items():
            pairs.sort()
            keys = np.array([h for h, _ in pairs], np.uint64)
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.index[width] = (keys, np.array([n for _, n in pairs]), table)

    def _candidates(self, hashes: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        for width, (keys, numbers, table) in self.index.items():
            rolled = rolling(hashes, width)
            hit = np.flatnonzero(table[(rolled >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            low = np.searchsorted(keys, rolled[hit], "left")
            high = np.searchsorted(keys, rolled[hit], "right")
            some = high > low
            hit, low, high = hit[some], low[some], high[some]
            starts = run_starts(counts)
            doc = np.searchsorted(starts, hit, "right") - 1
            stays = hit + width <= starts[doc] + counts[doc]  # within one document
            for d, a, b in zip(doc[stays].tolist(), low[stays].tolist(), high[stays].tolist()):
                found.update((d, int(n)) for n in numbers[a:b])
        return found

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, shared shingles, shingles of the item)`` of every contained item."""
        hashes, counts = word_arrays(texts, self.cache, lower=True, drop=_PUNCTUATION)
        starts = run_starts(counts)
        last, words, positions = -1, [], {}
        for doc, item in sorted(self._candidates(hashes, counts)):
            if doc != last:
                last, words, positions = doc, words_of(texts[doc]), {}
            width, own = self.width_of[item], self.sets[item]
            if width not in positions:
                rolled = rolling(hashes[starts[doc] : starts[doc] + counts[doc]], width)
                positions[width] = dict(zip(rolled.tolist(), range(len(rolled))))
            at = positions[width]
            shared = sum(
                1 for h, gram in own.items() if h in at and tuple(words[at[h] : at[h] + width]) == gram
            )
            if shared >= self.threshold * len(own) - 1e-9:
                yield doc, item, shared, len(own)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """Distinct ``(id, text)`` of the items, in blocks of bounded text."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.length("text") > 0).distinct()
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    block = F.pmod(F.xxhash64("text"), F.lit(count))
    for number in range(count):
        yield rows.filter(block == number).orderBy("id", "text").collect()


def _chunks(texts: list[str], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_ITEM_BYTES,
) -> DataFrame:
    """One row per (document, contained item): doc_id, item_id, n_shared, n_item, containment."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = rows.schema["doc_id"].dataType, items.schema[item_id_col].dataType
    schema = StructType(
        [StructField("doc_id", kinds[0]), StructField("item_id", kinds[1])]
        + [StructField(n, LongType()) for n in ("n_shared", "n_item")]
        + [StructField("containment", DoubleType())]
    )
    types = [to_arrow_type(f.dataType) for f in schema]
    names = schema.names

    def searcher(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean()
            ids, texts = shared.value
            index = ItemIndex(texts, threshold)
            for batch in batches:
                doc_ids = batch.column(0)
                docs_ = [t or "" for t in batch.column(1).to_pylist()]
                hits = [
                    (at + d, n, s, q)
                    for at, end in _chunks(docs_)
                    for d, n, s, q in index.search(docs_[at:end])
                ]
                d, n, s, q = zip(*hits) if hits else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.take(pa.array(d, pa.int64())),
                        pa.array([ids[i] for i in n], types[1]),
                        pa.array(s, pa.int64()),
                        pa.array(q, pa.int64()),
                        pa.array([a / b for a, b in zip(s, q)], pa.float64()),
                    ],
                    names=names,
                )

        return run

    parts = []
    for block in _blocks(items, item_id_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(([r["id"] for r in block], [r["text"] for r in block]))
        parts.append(rows.mapInArrow(searcher(shared), schema))
    return reduce(DataFrame.unionByName, parts)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_ITEM_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; no shuffle."""
    spark = prepare(docs.sparkSession)
    place = docs.columns.index(text_col)

    def keeper(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean()
            index = ItemIndex(shared.value, threshold)
            for batch in batches:
                texts = [t or "" for t in batch.column(place).cast(pa.string()).to_pylist()]
                clean = np.ones(len(texts), dtype=bool)
                for at, end in _chunks(texts):
                    for d, *_ in index.search(texts[at:end]):
                        clean[at + d] = False
                yield batch.filter(pa.array(clean))

        return run

    kept = docs
    for block in _blocks(items, item_id_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast([r["text"] for r in block])
        kept = kept.mapInArrow(keeper(shared), docs.schema)
    return kept


ship_by_value(__name__)
