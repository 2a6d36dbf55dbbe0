"""Sequence packing as vector bin packing with the dot-product heuristic.

Each sequence has simultaneous limits: tokens, segments (examples or pieces
in it) and loss-bearing tokens.  A sequence is filled one example at a time;
of the examples that fit in every dimension the one whose demand has the
largest dot product with the remaining capacity (both as shares of the
limits) goes in, so what is scarce in the open sequence is spent last.

Two operators share the packer:

* :func:`pack_examples` places indivisible instruction examples with given
  demands; an example beyond a limit gets a sequence of its own (``over``).
* :func:`pack_documents` tokenises texts, appends an end id and may cut a
  document anywhere.  Whole sequences are cut from the front of a document,
  what is left of it is packed, and when nothing fits any more the largest
  example is cut to fill the open sequence exactly.  What a task has left at
  its end fills sequences whose lengths are powers of two.

Packing runs where the rows are: each task packs its own input partition in
bounded windows, with no shuffle, so neither a long text nor a hot source
gathers anywhere.  The result depends on how the input is partitioned, but
each id lies in exactly one piece whatever the partitioning.

Defined cases: a null or empty text is one piece with the end id alone; null
or repeated ids are carried through; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tagweave.llm.common import lean, prepare
from tagweave.workers import ship_by_value

MAX_TOKENS = 4096
#: Pieces per sequence; an id costs at least one token, so this binds only for tiny documents.
MAX_SEGMENTS = 1024
END_ID = 2
#: Examples that a task chooses from, and the ids it holds, at a time.
WINDOW_ITEMS = 1024
WINDOW_IDS = 4 << 20


def choose(demand: np.ndarray, left: np.ndarray, limits: np.ndarray, free: np.ndarray) -> int:
    """Index of the best fitting row of ``demand`` among ``free`` ones, or -1."""
    fits = free & (demand <= left).all(axis=1)
    if not fits.any():
        return -1
    score = (demand / limits) @ (left / limits)
    return int(np.argmax(np.where(fits, score, -1.0)))


# --- tokenising ---------------------------------------------------------------

#: Pieces of a word as the tokenizer's own pattern has them, on plain words. Fixed value.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+"
#: Words of these characters need no Unicode normalisation.
_PLAIN = r"[!-~À-ÖØ-öø-ÿ]+"
_END = b"\xff"  # stands for the word-end mark; no UTF-8 text has this byte


class TokenIds(dict):
    """``word bytes -> its ids as little-endian uint32 bytes``; the first ``limit`` are remembered.

    White space always separates tokens here, so a text's ids are those of its
    words.  Plain words go through byte-pair merging by rank of the same
    vocabulary (merge order = id order), everything else through the
    tokenizer itself.
    """

    def __init__(self, path: str, limit: int = 800_000):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        to_byte = _byte_symbols()
        ranks = {}
        for token, number in vocab.items():
            mark = token.endswith("</w>")
            body = token[:-4] if mark else token
            if all(c in to_byte for c in body):
                ranks[bytes(to_byte[c] for c in body) + (_END if mark else b"")] = number
        self.merge = tiktoken.Encoding(
            "words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_single_piece
        self.pieces = re.compile(_PIECES).findall
        self.plain = re.compile(_PLAIN).fullmatch

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain(text) and "<|" not in text:
            ids = []
            for piece in self.pieces(text.lower()):
                ids += self.merge(piece.encode() + _END)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        value = np.array(ids, "<u4").tobytes()
        if len(self) < self.limit:
            self[word] = value
        return value

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# --- packing documents --------------------------------------------------------


class _Packer:
    """Packs the documents of one task; ``rows`` gathers finished pieces."""

    def __init__(self, limits: tuple[int, int, int], end_id: int, base: int):
        self.limits = np.array(limits, dtype=np.float64)
        self.size = limits[0]
        self.end = np.array([end_id], "<u4").tobytes()
        self.next = base
        self.items: list[list] = []  # [doc_id, ids, start, doc_tokens]: the rest of a document
        self.rows: list[tuple] = []

    def _emit(self, item: list, length: int, offset: int) -> None:
        doc_id, ids, start, total = item
        piece = memoryview(ids)[4 * start : 4 * (start + length)]
        self.rows.append((doc_id, start, length, zlib.crc32(piece), total, self.next, offset))
        item[2] = start + length

    def add(self, doc_id, ids: bytes) -> int:
        ids += self.end
        total = len(ids) // 4
        item = [doc_id, ids, 0, total]
        whole = min(self.size, int(self.limits[2]))
        while total - item[2] >= whole:
            self._emit(item, whole, 0)
            self.next += 1
        if item[2] < total:
            self.items.append(item)
        return total

    def pack(self, keep: int) -> None:
        """Fill sequences until less than ``keep`` tokens are left, or items for one sequence."""
        demand = np.array([[i[3] - i[2], 1.0, i[3] - i[2]] for i in self.items]).reshape(-1, 3)
        free = np.ones(len(self.items), dtype=bool)
        tokens = int(demand[:, 0].sum())
        while tokens >= keep and tokens:
            tokens -= self._fill(demand, free, self.size)
        self.items = [i for i, f in zip(self.items, free) if f]

    def _fill(self, demand: np.ndarray, free: np.ndarray, size: int) -> int:
        """One sequence of at most ``size`` tokens; returns its tokens."""
        limits = self.limits.copy()
        limits[0] = size
        left = limits.copy()
        while left[0] > 0 and left[1] > 0 and left[2] > 0:
            last = left[1] == 1
            best = -1 if last else choose(demand, left, limits, free)
            if best < 0:
                best = int(np.argmax(np.where(free, demand[:, 0], -1)))
                if not free[best]:
                    break
            take = int(min(demand[best, 0], left[0], left[2]))
            self._emit(self.items[best], take, int(size - left[0]))
            left -= (take, 1, take)
            demand[best, 0] -= take
            demand[best, 2] -= take
            free[best] = demand[best, 0] > 0
        self.next += 1
        return int(size - left[0])

    def finish(self) -> None:
        """What is left goes to sequences of power-of-two lengths."""
        demand = np.array([[i[3] - i[2], 1.0, i[3] - i[2]] for i in self.items]).reshape(-1, 3)
        free = np.ones(len(self.items), dtype=bool)
        tokens = int(demand[:, 0].sum())
        while tokens:
            size = 1 << (min(tokens, self.size).bit_length() - 1)
            tokens -= self._fill(demand, free, size)
        self.items = []


def _pack_partition(tokenizer: str, limits: tuple[int, int, int], end_id: int, id_type: pa.DataType):
    schema = pa.schema(
        [("doc_id", id_type)]
        + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words, packer, held = None, None, 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

        for batch in batches:
            if words is None:
                words = TokenIds(tokenizer)
                packer = _Packer(limits, end_id, TaskContext.get().partitionId() << 32)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held += packer.add(doc_id, words.ids(text or ""))
                if len(packer.items) >= WINDOW_ITEMS or held >= WINDOW_IDS:
                    packer.pack(keep=packer.size)
                    held = 0
                    yield out()
        if packer:
            packer.pack(keep=packer.size)
            packer.finish()
            yield out()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a tokenizer file that every worker can open.  Every token
    of a document bears loss; ``max_loss`` (default ``max_tokens``) limits it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = StructType([StructField("doc_id", kind)] + [StructField(n, LongType()) for n in names])
    limits = (max_tokens, max_segments, max_loss or max_tokens)
    return rows.mapInArrow(_pack_partition(tokenizer, limits, end_id, to_arrow_type(kind)), schema)


# --- packing instruction examples ----------------------------------------------


def _example_partition(limits: tuple[int, ...], id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("sequence_id", pa.int64()), ("place", pa.int64()), ("over", pa.bool_())])
    caps = np.array(limits, dtype=np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, demand, base = [], np.empty((0, len(caps))), 0
        base = TaskContext.get().partitionId() << 32

        def fill(until: int) -> pa.RecordBatch:
            nonlocal ids, demand, base
            rows, free = [], np.ones(len(ids), dtype=bool)
            for i in np.flatnonzero((demand > caps).any(axis=1)):
                rows.append((ids[i], base, 0, True))
                free[i], base = False, base + 1
            while free.sum() > until:
                left, place = caps.copy(), 0
                while (best := choose(demand, left, caps, free)) >= 0:
                    rows.append((ids[best], base, place, False))
                    left -= demand[best]
                    free[best], place = False, place + 1
                base += 1
            ids = [x for x, f in zip(ids, free) if f]
            demand = demand[free]
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, WINDOW_ITEMS):
                part = batch.slice(at, WINDOW_ITEMS)
                ids += part.column(0).to_pylist()
                more = [np.array(part.column(1 + k).to_pylist(), dtype=np.float64) for k in range(len(caps))]
                demand = np.vstack([demand, np.nan_to_num(np.column_stack(more))])
                yield fill(WINDOW_ITEMS // 4)
        yield fill(0)

    return run


def pack_examples(examples: DataFrame, limits: dict[str, int], id_col: str) -> DataFrame:
    """``(id, sequence_id, place, over)`` for indivisible examples.

    ``limits`` maps demand columns (tokens, segments, loss-bearing tokens, ...)
    to what a sequence holds of each; a null demand counts as 0.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    prepare(examples.sparkSession)
    kind = examples.schema[id_col].dataType
    rows = examples.select(F.col(id_col).alias("id"), *[F.col(c).cast("double") for c in limits])
    schema = StructType(
        [StructField("id", kind), StructField("sequence_id", LongType()), StructField("place", LongType())]
    ).add("over", "boolean")
    return rows.mapInArrow(_example_partition(tuple(limits.values()), to_arrow_type(kind)), schema)


ship_by_value(__name__)
