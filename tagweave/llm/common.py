"""Shared helpers of the training-data operators.

Row keys, reading tables, word hashing in Python workers and the compact
"slice" exchange: sorted 64-bit keys of one chunk of documents travel as one
binary value per slice instead of one row per key.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import ensure_checkpoint_dir
from tagweave.workers import ship_by_value

#: Settings these operators rely on; everything else is left as the session has it.
CONF = {
    # Files of a finished job's shuffles go at once, so that multi-job operators
    # need the disk of their largest job and not of all of them.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # An Arrow batch of documents is bounded in rows and in bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Set :data:`CONF` on the session and make sure that checkpoints have a folder."""
    for key, value in CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder and read back: for tables that
    are used twice, where column pruning and compression save what a checkpoint would not."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Name of the key column that :func:`with_key` adds, where it is free.
KEY = "__row_key"


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it (in any case of letters)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_key(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one stable long per row in column ``free_name(docs, KEY)``.

    Unique integer ids are their own keys, which hold however often the input
    is read again.  If an id is null or repeated, rows are numbered and the
    numbered table is written to the checkpoint folder, so that every later
    pass sees the same numbers.
    """
    prepare(docs.sparkSession)
    key = free_name(docs, KEY)
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        ids = docs.select(F.col(id_col).alias("id"))
        if ids.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
            return docs.withColumn(key, F.col(id_col).cast("long"))
    return docs.withColumn(key, F.monotonically_increasing_id()).checkpoint()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key long, doc_id, text)`` with one stable key per row; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return with_key(rows).select(F.col(KEY).alias("key"), "doc_id", "text")


def chunked(
    batches: Iterable[pd.DataFrame], text_col: str = "text", max_bytes: int = CHUNK_BYTES
) -> Iterator[pd.DataFrame]:
    """Cut pandas batches into frames of at most ``max_bytes`` of text (one row at least)."""
    for pdf in batches:
        if not len(pdf):
            continue
        size = pdf[text_col].str.len().to_numpy(dtype=np.int64)
        part = np.cumsum(size) // max_bytes
        for _, rows in pdf.groupby(part, sort=False):
            yield rows


def lean() -> None:
    """In a Python worker: large arrays go back to the system when they are freed.

    By default the C allocator keeps ever larger blocks for itself, and a worker
    that is used again holds the peak of every task it has run.  No effect where
    the C library has no such settings.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD: blocks from here on are mapped
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD: free memory that stays at the top
    except (OSError, AttributeError):
        pass
    pa.set_memory_pool(pa.system_memory_pool())


class WordHash(dict):
    """``word bytes -> xxh64``; the first ``limit`` words are remembered (frequent ones come early)."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


_P1, _P2, _P3, _P4, _P5 = map(
    np.uint64,
    (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5),
)
#: Words of as many bytes or more are hashed one by one.
_LONG = 32


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def word_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray, cache: WordHash) -> np.ndarray:
    """xxh64 of the words of ``sizes`` bytes at ``starts``, all short words at once: eight, four
    and single bytes at a time go into every hash that still has them, as xxh64 has it."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    out = sizes.astype(np.uint64) + _P5
    for k in range(_LONG // 8 - 1):
        on = np.flatnonzero(sizes >= 8 * (k + 1))
        if not len(on):
            break
        lane = _turned(eight[starts[on] + 8 * k] * _P2, 31) * _P1
        out[on] = _turned(out[on] ^ lane, 27) * _P1 + _P4
    at = starts + (sizes & ~7)
    on = np.flatnonzero(sizes & 4)
    out[on] = _turned(out[on] ^ ((eight[at[on]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at = starts + (sizes & ~3)
    for k in range(3):
        on = np.flatnonzero((sizes & 3) > k)
        out[on] = _turned(out[on] ^ (padded[at[on] + k].astype(np.uint64) * _P5), 11) * _P1
    out ^= out >> np.uint64(33)
    out *= _P2
    out ^= out >> np.uint64(29)
    out *= _P3
    out ^= out >> np.uint64(32)
    for k in np.flatnonzero(sizes >= _LONG).tolist():
        out[k] = cache[data[starts[k] : starts[k] + sizes[k]]]
    return out


def word_arrays(
    texts: Iterable[str], cache: WordHash, lower: bool = False, drop: bytes = b""
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and each text's word count.

    ``lower`` folds A-Z; bytes in ``drop`` are deleted first (words that lose
    all their bytes vanish).
    """
    raws = []
    for text in texts:
        raw = text.encode("utf-8", "replace")
        if lower:
            raw = raw.lower()
        raws.append(raw.translate(None, drop) if drop else raw)
    ends = np.cumsum(np.array([len(r) + 1 for r in raws], dtype=np.int64))
    data = b" ".join([b"", *raws, b""])
    joined = np.frombuffer(data, np.uint8)
    space = (joined == 0x20) | (joined - np.uint8(0x09) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1  # a word's first byte, the byte after it, and so on
    starts = edges[::2]
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return word_hashes(data, starts, edges[1::2] - starts, cache), counts


_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive combination of two arrays of 64-bit hashes."""
    x = (a * _M1) ^ (b + _M2)
    x ^= x >> _S
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive items, by doubling; length n - width + 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, have, out, at = 1, hashes, None, 0
    rest = width
    while True:
        if rest & power:
            piece = have[at : at + n]
            out = piece if out is None else mix(out, piece)
            at += power
            rest -= power
        if not rest:
            return out if width > 1 else out.copy()
        have = mix(have[:-power], have[power:])
        power *= 2


def run_starts(counts: np.ndarray) -> np.ndarray:
    """Start of each document in the concatenated array."""
    return np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.empty(0, np.int64)


def windows(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents of ``counts`` items laid end to end: start index of every run of
    ``width`` items that stays in one document, and the document of each."""
    inner = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), inner)
    first = np.repeat(run_starts(counts) - run_starts(inner), inner)
    return np.arange(len(doc)) + first, doc


# --- slice exchange ---------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes: the high bytes of small values compress to nothing."""
    return np.ascontiguousarray(
        values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    ).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Slice of each key: equal ranges of the 64-bit space (of its top 32 bits)."""
    return ((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def cut(keys: np.ndarray, slices: int) -> np.ndarray:
    """Borders of the slices in ascending keys (``slices + 1`` indexes)."""
    return np.searchsorted(slice_of(keys, slices), np.arange(slices + 1, dtype=np.uint64))


ENTRY_SCHEMA = "slice int, hashes binary, owner binary, extra binary, keys binary, ranks binary, batch long"
ENTRY_COLUMNS = ["slice", "hashes", "owner", "extra", "keys", "ranks", "batch"]


def entries(hashes, owner, extra, keys, ranks, slices: int, batch: int = 0) -> pd.DataFrame:
    """One row per slice: sorted hashes, their documents (as places in ``keys``) and a number
    each; ``batch`` says which rows were sent together."""
    order = np.argsort(hashes, kind="stable")
    hashes, owner, extra = hashes[order], owner[order], extra[order]
    borders = np.searchsorted(slice_of(hashes, slices), np.arange(slices + 1, dtype=np.uint64))
    rows = []
    for s in np.flatnonzero(np.diff(borders)):
        part = slice(borders[s], borders[s + 1])
        used, place = np.unique(owner[part], return_inverse=True)
        rows.append(
            (
                int(s),
                pack_sorted(hashes[part]),
                planes(place.astype(np.uint32)),
                planes(extra[part].astype(np.uint32)),
                planes(keys[used]),
                planes(ranks[used]),
                batch,
            )
        )
    return pd.DataFrame(rows, columns=ENTRY_COLUMNS)


def gathered(pdf: pd.DataFrame):
    """Entries of a slice in hash order: hash, key, rank, number, the group borders and
    each one's group, and the row of ``pdf`` it came in."""
    hashes, keys, ranks, extra = [], [], [], []
    for h, o, e, k, r in zip(pdf["hashes"], pdf["owner"], pdf["extra"], pdf["keys"], pdf["ranks"]):
        place = unplanes(o, np.uint32)
        hashes.append(unpack_sorted(h))
        keys.append(unplanes(k, np.int64)[place])
        ranks.append(unplanes(r, np.int64)[place])
        extra.append(unplanes(e, np.uint32))
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    return (
        h, np.concatenate(keys)[order], np.concatenate(ranks)[order], np.concatenate(extra)[order],
        np.flatnonzero(new), np.cumsum(new) - 1, np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])[order],
    )


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def slices_for(items: int, per_slice: int = 1_500_000, least: int = 12) -> int:
    """Slices so that each has about ``per_slice`` items, in memory of one task."""
    return max(least, -(-items // per_slice))


ship_by_value(__name__)
