"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary.  A
word (a run of letters, lower-cased, behind the vocabulary's word mark) has the
probability of all its segmentations into pieces together, summed by the
forward algorithm; a text the product over its words and the language's share
of the fitted documents.  A code point that is no piece is the product of its
byte pieces.

**Fit.** Expectation maximisation: the forward-backward algorithm gives each
piece's expected count in each language's words under the last round's
probabilities, additively smoothed, from uniform ones.  It reads about
``PER_LANGUAGE`` documents of each language at most, chosen by the hash of
their id; the word counts are a table, the expected counts are added up by
Spark, and a round returns one number per piece and language.

**Score.** One pass, no shuffle.  Distinct words of a batch go through the
forward algorithm together, all of one length in one array; a task remembers
``HELD_WORDS`` words.  The steps are scaled so that every prefix has
probability one, so runs of any length neither underflow nor need logarithms.

Broadcast: pieces x languages probabilities, with at most ``MAX_MODEL``
numbers (the vocabulary is fixed; more languages than that raise).

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
ties go to the language that sorts first; a null id is not held out; a null
language is not learned from; with nothing to learn from all is ``und``; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import prepare, stage
from tagweave.workers import ship_by_value

#: Documents of a language that the fit reads, about.
PER_LANGUAGE = 4000
ROUNDS = 4
SMOOTHING = 0.1
#: Probabilities in the broadcast model (64 MB).
MAX_MODEL = 8 << 20
#: Words whose scores a task remembers, and words that it adds up before sending them.
HELD_WORDS = 200_000
#: Words that go through the forward algorithm at a time.
GROUP = 4096

UNKNOWN = "und"
MARK = "▁"
_letters = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    return _letters(text.lower())


@dataclass
class Pieces:
    """The vocabulary for array lookups: sorted 64-bit hashes of the pieces, the place of each,
    which table slots have any, the places of the 256 byte pieces, and the longest piece."""

    hashes: np.ndarray
    places: np.ndarray
    slots: np.ndarray
    byte: list[int]
    longest: int
    size: int


_STEP, _CODE, _SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: log2 of the slots that sort out most strings that are no pieces.
_BITS = 20


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * _SLOT) >> np.uint64(64 - _BITS)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row a place."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    return flat.reshape(len(words), -1).T.astype(np.uint64)


def _extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more code point each."""
    return hashes * _STEP + (codes + np.uint64(1)) * _CODE


def pieces_of(places: dict[str, int], byte: list[int], size: int) -> Pieces:
    hashes, order = [], []
    for piece, place in places.items():
        codes, h = _codes([piece]), np.zeros(1, np.uint64)
        for code in codes:
            h = _extend(h, code)
        hashes.append(h[0])
        order.append(place)
    hashes, order = np.array(hashes, np.uint64), np.array(order, np.int32)
    by = np.argsort(hashes)
    slots = np.zeros(1 << _BITS, bool)
    slots[_slot(hashes)] = True
    return Pieces(hashes[by], order[by], slots, byte, max(map(len, places)), size)


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece vocabulary file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    places, byte = {}, [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i)):
            places[piece] = i
    return pieces_of(places, byte, model.get_piece_size())


class Lattice:
    """All segmentations of words of one length, as places of their pieces.

    ``ids[j][k]``: per word the place of the piece of k + 1 code points that
    ends behind code point j, or -1.  Unknown code points get places of their
    own behind the vocabulary's, in the order of ``spare``.
    """

    def __init__(self, words: list[str], pieces: Pieces, spare: dict[str, int]):
        codes = _codes(words)
        size, most = len(codes), min(len(codes), pieces.longest)
        self.ids = np.full((size, most, len(words)), -1, np.int32)
        ending = np.zeros((size, len(words)), np.uint64)  # strings of k code points ending behind j
        for k in range(most):
            ending = _extend(ending if k == 0 else ending[:-1], codes[k:])
            j, w = np.nonzero(pieces.slots[_slot(ending)])
            found = ending[j, w]
            at = np.minimum(np.searchsorted(pieces.hashes, found), len(pieces.hashes) - 1)
            hit = pieces.hashes[at] == found
            self.ids[j[hit] + k, k, w[hit]] = pieces.places[at[hit]]
        j, w = np.nonzero(self.ids[:, 0] < 0)
        for a, b in zip(j.tolist(), w.tolist()):
            self.ids[a, 0, b] = pieces.size + spare.setdefault(words[b][a], len(spare))

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log probability per word and language, and the scale of each step.

        ``ahead[k]``: one over the scales since the start of a piece of k + 1 code points."""
        size, most, words = self.ids.shape
        ahead = np.ones((most + 1, words, p.shape[1]))
        total, scales = np.zeros((words, p.shape[1])), []
        for j in range(size):
            ids = self.ids[j, : j + 1]
            step = (p[ids] * ahead[: len(ids)]).sum(0)
            total += np.log(step)
            scales.append(step)
            ahead[1:] = ahead[:-1] / step
            ahead[0] = 1
        return total, scales

    def expected(self, p: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Add the expected piece counts of the words, ``weight`` per word and language, to ``into``."""
        _, scales = self.forward(p)
        behind = [np.zeros_like(weight) for _ in range(len(self.ids) + 1)]
        behind[-1] = weight
        for j in range(len(self.ids) - 1, -1, -1):
            share, ids = behind[j + 1], self.ids[j, : j + 1]
            mass = np.empty((*ids.shape, p.shape[1]))
            for k in range(len(ids)):
                share = share / scales[j - k]
                mass[k] = p[ids[k]] * share
                behind[j - k] += mass[k]
            hit = ids >= 0
            for lang in range(p.shape[1]):
                into[:, lang] += np.bincount(ids[hit], mass[..., lang][hit], len(into))


def _grouped(words: list[str]) -> Iterator[list[int]]:
    """Places of words of one length, at most ``GROUP`` (fewer for long ones)."""
    by: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        by.setdefault(len(word), []).append(at)
    for size, places in by.items():
        most = max(1, min(GROUP, (GROUP * 32) // size))
        for i in range(0, len(places), most):
            yield places[i : i + most]


def extended(p: np.ndarray, pieces: Pieces, spare: dict[str, int]) -> np.ndarray:
    """``p`` with a row for each spare code point, and a last row of zeros (place -1)."""
    rows = [p]
    for char in spare:
        rows.append(np.prod(p[[pieces.byte[b] for b in char.encode("utf-8", "replace")]], axis=0, keepdims=True))
    rows.append(np.zeros((1, p.shape[1])))
    return np.concatenate(rows)


def word_scores(words: list[str], p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log probability of each word in each language; zeros for runs without a letter."""
    out = np.zeros((len(words), p.shape[1]))
    marked = [MARK + w for w in words]
    for places in _grouped(marked):
        spare: dict[str, int] = {}
        lattice = Lattice([marked[i] for i in places], pieces, spare)
        out[places] = lattice.forward(extended(p, pieces, spare))[0]
    return out


def expected_counts(words: list[str], weight: np.ndarray, p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected count of each piece in each language over the words."""
    out = np.zeros_like(p)
    marked = [MARK + w for w in words]
    for places in _grouped(marked):
        spare: dict[str, int] = {}
        lattice = Lattice([marked[i] for i in places], pieces, spare)
        q = extended(p, pieces, spare)
        into = np.zeros_like(q)
        lattice.expected(q, weight[places], into)
        out += into[: len(p)]
        for char, at in spare.items():
            for b in char.encode("utf-8", "replace"):
                out[pieces.byte[b]] += into[pieces.size + at]
    return out


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    p: np.ndarray
    pieces: Pieces


def _word_counts(docs: DataFrame) -> DataFrame:
    """``(word, langs array<string>, ns array<long>)`` of ``(lang, text)`` rows."""

    def frame(held):
        langs, words = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs), pa.array(words), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(words_of(text)).items():
                    held[lang, word] += n
                if len(held) > HELD_WORDS:
                    yield frame(held)
                    held = Counter()
        if held:
            yield frame(held)

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    counts = counts.groupBy("word", "lang").agg(F.sum("n").alias("n"))
    return counts.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by")).select(
        "word", "by.lang", "by.n"
    )


def fit(
    docs: DataFrame,
    learn: Column,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    rounds: int = ROUNDS,
) -> Model | None:
    """The model of the rows where ``learn`` holds (``None`` if there are none).

    ``vocabulary``: path of the piece file, read on the driver only.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.where(F.coalesce(learn, F.lit(True)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("hash"),
    )
    pieces = load_pieces(vocabulary)
    seen = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang")
            .limit(MAX_MODEL // pieces.size + 1).collect()}
    if not seen:
        return None
    if len(seen) * pieces.size > MAX_MODEL:
        raise ValueError(f"more than {MAX_MODEL // pieces.size} languages")
    languages = sorted(seen)
    place = {lang: i for i, lang in enumerate(languages)}
    shares = F.create_map(*[F.lit(x) for lang, n in seen.items() for x in (lang, int(min(1.0, per_language / n) * (1 << 30)))])
    counts = stage(_word_counts(rows.where(F.col("hash") < shares[F.col("lang")])))
    p = np.full((pieces.size, len(languages)), 1.0 / pieces.size)
    for _ in range(rounds):
        p = _round(spark, counts, place, p, pieces)
    prior = np.array([seen[lang] for lang in languages], float)
    return Model(languages, np.log(prior / prior.sum()), p, pieces)


def _round(spark, counts: DataFrame, place: dict[str, int], p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Probabilities from the expected counts under ``p``."""
    model = spark.sparkContext.broadcast((place, p, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, p, pieces = model.value
        total = np.zeros_like(p)
        for batch in batches:
            words = batch.column(0).to_pylist()
            weight = np.zeros((len(words), len(place)))
            for i, (langs, ns) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for lang, n in zip(langs, ns):
                    weight[i, place[lang]] = n
            total += expected_counts(words, weight, p, pieces)
        at, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(lang), pa.array(total[at, lang])], names=["piece", "lang", "n"]
        )

    sums = counts.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    c = np.full_like(p, SMOOTHING)
    c[found["piece"], found["lang"]] += found["n"]
    model.unpersist()
    return c / c.sum(0)


class WordScores:
    """Scores of the words a task has met."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self):
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)))

    def learn(self, words) -> None:
        """Make sure that all ``words`` have their scores."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > HELD_WORDS and self.place:
            self._clear()
            new = list(words)
        start, end = len(self.place), len(self.place) + len(new)
        while len(self.table) < end:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if new:
            self.table[start:end] = word_scores(new, self.model.p, self.model.pieces)
            self.place.update(zip(new, range(start, end)))


def predict(model: Model, texts: list[str | None], held: WordScores) -> tuple[list[str], np.ndarray]:
    """Language and its posterior for each text."""
    counted = [Counter(words_of(t)) if t else Counter() for t in texts]
    for own in counted:  # the few runs of number signs and the like that hold no letter
        for word in [w for w in own if not w.isalpha() and not any(map(str.isalpha, w))]:
            del own[word]
    held.learn(set().union(*counted))
    languages, scores = [], np.zeros(len(texts))
    for i, own in enumerate(counted):
        if not own:
            languages.append(UNKNOWN)
            continue
        at = np.fromiter(map(held.place.__getitem__, own), np.int64, len(own))
        n = np.fromiter(own.values(), np.float64, len(own))
        total = model.prior + n @ held.table[at]
        best = int(total.argmax())
        languages.append(model.languages[best])
        scores[i] = 1.0 / np.exp(total - total[best]).sum()
    return languages, scores


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` (the last column ``text``) with ``lang_pred`` and ``score`` in its place."""
    kept = rows.columns[:-1]
    if model is None:
        return rows.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    fields = [f for f in rows.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordScores(sent.value)
        for batch in batches:
            out, scores = predict(sent.value, batch.column(batch.num_columns - 1).to_pylist(), held)
            columns = [*batch.columns[:-1], pa.array(out, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def language_id(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Rows whose crc32(id as text) mod 4 is 2 are held out of the fit.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs, ~held_out, vocabulary, id_col, text_col, lang_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    return score(rows, model)


ship_by_value(__name__)
