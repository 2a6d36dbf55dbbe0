"""Merkle manifest, spelling variants and language identification against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import language_id as L
from tagweave.llm import merkle as M
from tagweave.llm import spelling as S
from tagweave.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(hashes):
    """Root, and each one's siblings as (digest or None, is left), by whole levels."""
    paths, own = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, up_own = [], []
        for i in range(0, len(hashes), 2):
            run = hashes[i : i + 2]
            for side in range(len(run)):
                for leaf in own[i + side]:
                    paths[leaf].append((run[1 - side], side == 1) if len(run) == 2 else (None, False))
            up.append(H("".join(run)))
            up_own.append(sum(own[i : i + 2], []))
        hashes, own = up, up_own
    return hashes[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for d, text, lang, source, n in rows:
        hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        leaf, start = (H("".join(map(field, (d, source, lang, m, text)))) for m in (n, n + 1 if hit else n))
        by[lang].append((d is not None, d or 0, leaf, start))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    low = {x: climbed([r[2] for r in sorted(by[x])]) for x in langs}
    root, high = climbed([low[x][0] for x in langs])
    out = []
    for rank, x in enumerate(langs):
        for (known, d, leaf, folded), path in zip(sorted(by[x]), low[x][1]):
            for h, left in path + high[rank]:
                folded = H(folded if h is None else h + folded if left else folded + h)
            proof = H("".join(h for h, _ in path + high[rank] if h))
            out.append((d if known else None, leaf, low[x][0], root, proof, folded, folded == root))
    return Counter(out)


MANIFEST_ROWS = [(i, "t" * (i % 5), random.Random(i).choice(["a", "b", None, "é"]), "s", i) for i in range(90)] + [
    (None, "x", "a", None, None), (7, None, "z", "s", 3), (7, None, "z", "s", 3), (5, "", "a", "s", None),
    (11, "same", "a", "s", 1), (11, "other", "a", "s", 1), (400, "only", "lone", "s", 2),
]


@pytest.mark.parametrize("stride", [1, 2, 8])
def test_manifest_equals_whole_level_tree(spark, stride):
    docs = spark.createDataFrame(MANIFEST_ROWS, DOCS).withColumn("tree", F.lit("clash")).withColumn("block", F.lit(1))
    got = M.merkle_manifest(docs, tampered=M.tampered_counts(), stride=stride).collect()
    assert Counter(map(tuple, got)) == brute_manifest(MANIFEST_ROWS)
    assert 0 < sum(r["verified"] for r in got) < len(got)


def test_manifest_of_one_leaf_and_none(spark):
    one = M.merkle_manifest(spark.createDataFrame([(1, "a", None, None, 1)], DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == H("")
    none = M.merkle_manifest(spark.createDataFrame([], DOCS))
    assert none.collect() == [] and none.columns[0] == "doc_id" and len(none.columns) == 7


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(seed, letters, count):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(count)}
    for w in list(words)[: count // 2]:
        at = rng.randrange(len(w) + 1)
        words |= {w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]}
    return sorted(w for w in words if len(w) >= 7)


@pytest.mark.parametrize("letters, limit", [("ab", 10**6), ("abcé", 10**6), ("ab", 0), ("ab", 40)])
def test_near_pairs_are_all_pairs_whatever_the_dictionary(spark, letters, limit):
    words = some_words(3, letters, 120)
    table = spark.createDataFrame(list(enumerate(words)), "place long, word string")
    frequent = {} if not limit else S.frequent_grams(table, min_count=2, limit=limit)
    got = {frozenset((words[r["a"]], words[r["b"]])) for r in S.near_pairs(table, frequent).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}
    assert got == want and want


def test_bound_holds_and_leaves_a_gram():
    """An edit changes at most the bounded number of grams, and never all."""
    words = some_words(5, "abc", 60)
    grams = Counter()
    for w in words:
        p = S.padded(w)
        grams.update(p[i : i + q] for q in range(S.Q_MIN, S.Q_MAX + 1) for i in range(len(p) - q + 1))
    frequent = {g: n for g, n in grams.items() if n >= 5}
    tail = S.tails(frequent)
    for w in words[:40]:
        own = S.decompose(S.padded(w), frequent)
        bound = S.affected(S.padded(w), own, tail)
        assert bound < len(own)
        for at in range(len(w) + 1):
            for edited in {w[:at] + "b" + w[at:], w[:at] + w[at + 1 :], w[:at] + "c" + w[at + 1 :]}:
                left = Counter(g for _, g in S.decompose(S.padded(edited), frequent))
                assert sum((Counter(g for _, g in own) & left).values()) >= len(own) - bound


def brute_variants(rows):
    n = Counter()
    for d, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run and d is not None:
                h = zlib.crc32(f"{d}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
            run = ""
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return Counter(out)


def test_variants_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["Straßen", "GOVERNMENT", "governmnt", "governmn", "ÉTRANGER", "Étranger", "abcdefgh×", "short", "abcdefgi×"]
    rows = [(i, " ".join(rng.choices(words, (5, 150, 14, 2, 3, 3, 2, 9, 2), k=30)) + "1x_") for i in range(120)]
    rows += [(None, "government " * 4), (3, None), (4, ""), (5, "governmentgovernment" * 50), (5, "GOVERNMENT9government")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    got = S.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == brute_variants(rows)
    assert S.spelling_variants(docs.where("false")).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    pieces = L.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
    return pieces, {m.id_to_piece(i): i for i in plain}


WORDS = ["hello", "straße", "ñandú", "漢字abc", "x", "internationalisation", "ꙮꙮ", "zz", "de"]


def test_forward_sums_all_segmentations(vocabulary):
    pieces, place = vocabulary
    p = np.random.default_rng(1).random((pieces.size, 2))
    p /= p.sum(0)

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            if word[:k] in place:
                out = out + p[place[word[:k]]] * total(word[k:])
            elif k == 1:
                out = out + np.prod(p[[pieces.byte[b] for b in word[0].encode()]], axis=0) * total(word[1:])
        return out

    short = [w for w in WORDS if len(w) < 9]
    want = np.log([total(L.MARK + w) for w in short])
    assert np.allclose(L.word_scores(short, p, pieces), want)
    long = L.word_scores(["ab" * 5000], p, pieces)
    assert np.isfinite(long).all() and (long < -1000).all()


def test_expected_counts_are_the_gradient(vocabulary):
    """The expected count of a piece is p * d log P / d p."""
    pieces, place = vocabulary
    p = np.random.default_rng(2).random((pieces.size, 2))
    p /= p.sum(0)
    got = L.expected_counts(WORDS, np.ones((len(WORDS), 2)), p, pieces)
    for piece in ("he", "▁", "ll", "a", "ation"):
        q, e = p.copy(), 1e-5
        q[place[piece]] *= 1 + e
        slope = (L.word_scores(WORDS, q, pieces) - L.word_scores(WORDS, p, pieces)).sum(0) / e
        assert np.allclose(got[place[piece]], slope, atol=1e-4)


def test_languages_of_held_out_texts(spark):
    rng = random.Random(4)
    syllables = {"aa": ["the", "ing", "tion", "was"], "bb": ["der", "sch", "ung", "ein"], "cc": ["ção", "que", "mente", "los"]}
    rows = [
        (i, " ".join("".join(rng.choices(syllables[x], k=2)) for _ in range(12)), x, x)
        for i in range(300)
        for x in [rng.choice(["aa", "bb", "cc"])]
    ]
    odd = [(900, None, "aa", ""), (901, "12 ² __ !", "aa", ""), (902, "", None, ""), (None, "derung schein", "bb", "bb"),
           (903, "thetion " * 20000, "aa", "aa"), (904, "derung derung", None, "bb"), (904, "derung derung", None, "bb")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, truth string")
    docs = docs.withColumn("score", F.lit("x")).withColumn("hash", F.lit(1))
    got = L.language_id(docs.repartition(3), tokenizer_path("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows) + len(odd)
    truth = {r[0]: r[3] for r in rows + odd}
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert r["lang_pred"] == (truth[r["doc_id"]] or "und") and (r["lang_pred"] != "und" or r["score"] == 0)
    nothing = L.language_id(docs.withColumn("lang", F.lit(None).cast("string")), tokenizer_path("piece_bpe_32k.model"))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}
    assert L.language_id(docs.where("false"), tokenizer_path("piece_bpe_32k.model")).collect() == []
