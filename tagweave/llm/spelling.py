"""Spelling variants of a corpus vocabulary: words at edit distance one, by a variable-length gram index.

**Dictionary.** Words are padded with marks at both ends.  Grams of ``Q_MIN``
to ``Q_MAX`` code points are counted over a sample of at most about ``SAMPLE``
words, and the frequent ones kept (``MIN_COUNT`` places or more, at most
``MAX_FREQUENT``; the prefix of a frequent gram is frequent).  A gram of the
dictionary is a frequent gram and one more code point: what is frequent is
extended, below ``Q_MAX``, and what is rare is pruned.  The dictionary decides
speed only: results do not depend on it.

**Decomposition.** From every place the gram is extended while it is frequent;
grams that end no later than an earlier one are dropped.

**Bounds.** One edit changes the grams that span it.  Grams that lie wholly
before it stay, as extension looks at nothing behind their end.  Of the grams
after it, one can be lost only to a gram that starts before it and reaches its
end; then the code points between edit and end must end a frequent gram.  The
largest number of grams so affected, over all places of an edit, is the word's
bound; the marks keep it below the number of its grams (:func:`affected`).

**Merging.** Only a word's ``bound + 1`` rarest grams enter the lists (any one
order of the grams is exact): the rarest gram that two near words share is in
both prefixes, at the same place from one end, and the edit is on one side of
it.  That side is taken in ``PARTS`` parts; the edit is in one of them and all
else is equal, so a list is keyed by the gram, its place, the length, the part
and all code points outside of the part.  Lists are joined with the edit
distance as part of the join condition: pairs of a list that are not near are
never rows, and the adaptive planner can split a long list.

**Scale.** Words are counted with map-side sums, the vocabulary is a table;
broadcast is only the dictionary.

Defined cases: a null text has no words; a null id deletes nothing; rows with
equal ids count each; an empty table gives no words; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import prepare, stage
from tagweave.workers import ship_by_value

MIN_LENGTH = 7
MIN_OCCURRENCES = 2
#: A form occurs this many times as often.
RATIO = 10

#: Words that a task adds up before it sends them.
HELD_WORDS = 200_000

Q_MIN, Q_MAX = 2, 3
#: Centre of the unsigned 64-bit range.
HALF = 1 << 63
#: Parts of the code points on one side of a gram, one of which holds the edit.
PARTS = 3
#: Words that the dictionary is fitted on, and its bounds.
SAMPLE = 200_000
MIN_COUNT = 16
MAX_FREQUENT = 100_000

_START, _END = "\x02", "\x03"


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31, min_length: int = MIN_LENGTH,
    min_occurrences: int = MIN_OCCURRENCES,
) -> DataFrame:
    """``(word, n)``: runs ``[A-Za-z\\u00C0-\\u00FF]+`` with only A-Z folded, a code point deleted where
    ``every`` divides the crc32 of ``<id>:<run>``, that have at least ``min_length`` code points
    and ``min_occurrences`` places.  A task adds up to ``HELD_WORDS`` words before it sends them."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Shorter runs give no word, and a run as long as that is found whole.
    runs = re.compile("[a-z\u00c0-\u00ff]{%d,}" % min_length).findall

    def frame(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                # bytes.lower() folds A-Z and nothing else
                own = Counter(runs(text.encode("utf-8", "replace").lower().decode("utf-8")))
                prefix = None if name is None else zlib.crc32(f"{name}:".encode())
                for word, n in own.items():
                    if prefix is not None:
                        h = zlib.crc32(word.encode(), prefix)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield frame(held)
                    held = Counter()
        if held:
            yield frame(held)

    words = rows.mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_occurrences)


def padded(word: str) -> str:
    return _START * (Q_MAX - 1) + word + _END * (Q_MAX - 1)


def frequent_grams(
    words: DataFrame, sample: int = SAMPLE, min_count: int = MIN_COUNT, limit: int = MAX_FREQUENT
) -> dict[str, int]:
    """Counts of the frequent padded grams, by falling count, at most ``limit``."""
    share = min(1.0, sample / max(1, words.count()))
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    text = F.concat(F.lit(_START * (Q_MAX - 1)), "word", F.lit(_END * (Q_MAX - 1)))
    places = lambda q: F.sequence(F.lit(1), F.char_length("p") - q + 1)
    grams = [F.transform(places(q), lambda i, q=q: F.substring("p", i, F.lit(q))) for q in range(Q_MIN, Q_MAX + 1)]
    counts = (
        picked.select(text.alias("p"))
        .select(F.explode(F.concat(*grams)).alias("gram"))
        .groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_count)
    )
    top = counts.orderBy(F.col("c").desc(), F.char_length("gram"), "gram").limit(limit)
    return {gram: c for gram, c in top.collect()}


def tails(frequent) -> set[str]:
    """Every suffix of every frequent gram."""
    return {g[i:] for g in frequent for i in range(len(g) + 1)}


def decompose(padded_word: str, frequent) -> list[tuple[int, str]]:
    """The variable grams ``(place, gram)``."""
    size, reach, grams = len(padded_word), 0, []
    for i in range(size - Q_MIN + 1):
        e, top = i + Q_MIN, min(i + Q_MAX, size)
        while e < top and padded_word[i:e] in frequent:
            e += 1
        if e > reach:
            grams.append((i, padded_word[i:e]))
            reach = e
    return grams


def affected(padded_word: str, grams: list[tuple[int, str]], tail: set[str]) -> int:
    """The most grams that one edit of the word can change.

    It is less than their number: the first gram starts at 0, the last ends at
    the end, and with ``Q_MAX - 1`` marks a side and two code points no edit
    of the word reaches both.
    """
    size = len(padded_word)
    changed = [0] * (size + 1)  # by the place of a replaced or deleted code point
    inserted = [0] * (size + 1)  # by the place before which one comes in
    for i, g in grams:
        e = i + len(g)
        for at in range(i, e):
            changed[at] += 1
        for at in range(i + 1, e):
            inserted[at] += 1
        for at in range(max(0, e - Q_MAX), i):
            changed[at] += padded_word[at + 1 : e - 1] in tail
        for at in range(max(0, e - Q_MAX + 1), i + 1):
            inserted[at] += padded_word[at : e - 1] in tail
    first, end = Q_MAX - 1, size - Q_MAX + 1
    return max(*changed[first:end], *inserted[first : end + 1])


def _marks(gram: str) -> int:
    return gram.count(_START) + gram.count(_END)


def _parts(start: int, end: int):
    """``PARTS`` ranges that cover ``[start, end)``, one at least."""
    width = max(1, -(-(end - start) // PARTS))
    for at in range(start, max(end, start + 1), width):
        yield at, min(at + width, end)


def word_entries(place: int, word: str, frequent, tail: set[str], rows: list) -> None:
    """Append ``(key, longer, part, place)``: a word's entries under its own length, and as the
    longer word under one code point less; ``part`` is the part that the key leaves out."""
    p, size, pad = padded(word), len(word), Q_MAX - 1
    grams = decompose(p, frequent)
    bound = affected(p, grams, tail)
    rare = sorted([(_marks(g), frequent.get(g, 0), g, i) for i, g in grams])[: bound + 1]
    digest = xxhash.xxh64_intdigest
    for _, _, g, i in rare:
        start, end = i - pad, i - pad + len(g)
        for longer in (False, True):
            length = size - longer
            if end <= size:  # the edit comes behind the gram
                name = f"{i} {length} {g} "
                for a, b in _parts(end if end > 0 else 0, length):
                    b += longer
                    rows.append((digest(f"{name}{word[:a]} {word[b:]}") - HALF, longer, word[a:b], place))
            if start >= longer:  # the edit comes before it
                name = f"{i - size - 1} {length} {g} "
                for a, b in _parts(0, (start if start < size else size) - longer):
                    b += longer
                    rows.append((digest(f"{name}{word[:a]} {word[b:]}") - HALF, longer, word[a:b], place))


def list_entries(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """The entries of all ``(place, word)`` rows, at most some 8,192 a batch."""
    dictionary = words.sparkSession.sparkContext.broadcast(frequent)
    types = [("key", pa.int64()), ("longer", pa.bool_()), ("part", pa.string()), ("place", pa.int64())]

    def frame(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        tail, rows = tails(known), []
        for batch in batches:
            for place, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                word_entries(place, word, known, tail, rows)
                if len(rows) >= 8192:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    return words.select("place", "word").mapInArrow(run, "key long, longer boolean, part string, place long")


def near_pairs(words: DataFrame, frequent: dict[str, int] | None = None) -> DataFrame:
    """``(a, b)``: the places of all pairs of ``(place, word)`` rows at edit distance one, once each."""
    entries = list_entries(words, frequent_grams(words) if frequent is None else frequent).repartition("key")
    # Words of a list are equal outside of the part.  Of two words of one length the
    # first is ``a``; a longer one is always ``b``.  No condition is on one side alone:
    # then both sides read one exchange.
    near = F.expr(
        "x.key = y.key and if(y.longer, not x.longer, x.place < y.place and not x.longer)"
        " and levenshtein(x.part, y.part, 1) = 1"
    )
    pairs = entries.alias("x").join(entries.alias("y"), near)
    return pairs.select(F.col("x.place").alias("a"), F.col("y.place").alias("b")).distinct()


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    prepare(docs.sparkSession)
    words = stage(vocabulary(docs, id_col, text_col).withColumn("place", F.monotonically_increasing_id()))
    pairs = stage(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("place").alias("b"), F.col("word").alias("near"), F.col("n").alias("n_b"))
    best = both.join(other, "b").groupBy(F.col("a").alias("place")).agg(
        F.count(F.lit(1)).alias("n_near"),
        F.max("n_b").alias("most"),
        F.min_by("near", F.struct(-F.col("n_b"), F.col("near"))).alias("nearest"),
    )
    has_form = F.col("most") >= ratio * F.col("n")
    table = stage(
        words.join(best, "place", "left").select(
            "word",
            F.when(has_form, F.col("nearest")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("most")).alias("form_n"),
        )
    )
    # Counts grow by ``ratio`` along the forms, so their number of digits bounds the chain;
    # each round doubles the steps that a root is away.
    most = words.agg(F.max("n")).first()[0] or 1
    steps, rounds = max(1, len(str(most))), 0
    while 1 << rounds < steps:
        rounds += 1
    roots = table.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(rounds):
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        roots = roots.join(up, "root").select("word", F.col("higher").alias("root")).checkpoint()
    return table.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")


ship_by_value(__name__)
