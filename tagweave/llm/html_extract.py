"""Main text of web pages by a linear-chain conditional random field.

A page is cut into DOM leaf blocks: runs of text between block-level tags.
Each block has features of its ancestors (tags, words of their class and id)
and of its text (length, share of link text, ending, position); a CRF over
the sequence of blocks, with the two labels *article* and *other*, is decoded
by Viterbi, and the article blocks are the main text.

Training pages are labelled by their publishers: blocks inside ``article``,
``main`` or an ``articleBody`` element, and outside of navigation and the
like, are article text.  So that the field does not lean on that one mark,
each labelled page is also used in other clothes: its own blocks are set into
page frames that draw their tags and class names at random (:data:`FRAMES`),
with side bars, notices, forms and reader comments, sometimes with no
``article`` mark at all.  At most ``MAX_TRAIN`` pages (those whose hashed ids
are smallest) are read for training, in one task; every page is decoded whole
in a pass without a shuffle.

Defined cases: null and empty html give an empty text; markup that is never
closed ends with the page, but an svg, object, canvas or select without an end
tag hides nothing; formulas (``math``) are text; repeated rows and null ids are extracted row by
row; a table without a labelled page is trained on blocks of ten words or
more in frames; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tagweave.llm.common import prepare
from tagweave.workers import ship_by_value

MAX_TRAIN = 300
#: Pages longer than this are not drawn for training (they are decoded like any other).
MAX_TRAIN_CHARS = 20_000
STEPS = 150

# Fixed values of HTML: elements that never show text (and those of them that hide
# the rest of the page if they are not closed), that break a line of text, that have
# no end tag, and whose start tag closes an open one.
HIDDEN = frozenset("script style template noscript svg iframe object canvas title select textarea".split())
TO_THE_END = HIDDEN - {"svg", "object", "canvas", "select"}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
#: An open paragraph also ends where any of these starts.
ENDS_P = BLOCK - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "legend"}
#: Elements that say nothing about the part of the page they stand in.
PLAIN = frozenset(
    "p div span li ul ol dl dt dd table tbody thead tfoot tr td th h1 h2 h3 h4 h5 h6 blockquote pre center "
    "figure figcaption hgroup section details summary".split()
)
SCOPES = frozenset("ul ol dl table article section div aside nav main body html".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAME = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """One leaf block: text, open elements from the outside in, and link characters."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = " ".join(a or b or c for a, b, c in _NAME.findall(attributes))
    return tuple(dict.fromkeys(w.lower() for w in _WORD.findall(found)))


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order, with references decoded and white space folded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = links = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, tuple(e for e in stack if e[0] in BLOCK), linked))
            pieces.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        end = tag.start() if tag else size
        if end > at:
            piece = page[at:end]
            pieces.append(piece)
            if links:
                linked += len(piece)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing = tag[1] or tag[4]
        attributes = tag[3] or tag[6] or ""
        if closing:
            if name in BLOCK:
                flush()
            elif name == "br":
                pieces.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:
                    break
            links = sum(e[0] == "a" for e in stack)
            continue
        if name in HIDDEN and not attributes.endswith("/"):
            stop = None if name in unclosed else re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif name in TO_THE_END:
                at = size
            else:  # only the tag is skipped; no later one has an end tag either
                unclosed.add(name)
            continue
        if name in BLOCK:
            flush()
            gone = CLOSES.get(name, frozenset()) | (frozenset(["p"]) if name in ENDS_P else frozenset())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in gone:
                    del stack[k:]
                    links = sum(e[0] == "a" for e in stack)
                elif stack[k][0] in SCOPES:
                    break
        elif name in VOID:
            pieces.append(" ")
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, _names(attributes)))
            links += name == "a"
    flush()
    return out


# --- features -------------------------------------------------------------------


def path_features(path: tuple) -> list[str]:
    found = ["bias"]
    for tag, names in path:
        found.append("in:" + tag)
        found += ["name:" + n for n in names]
    if path:
        found.append("own:" + path[-1][0])
    for tag, names in reversed(path):
        if names or tag not in PLAIN:  # the closest element that says what it is
            found.append("near:" + tag)
            found += ["nearname:" + n for n in names]
            break
    return list(dict.fromkeys(found))


def text_key(block: Block, place: int, total: int) -> tuple:
    """The text features of a block, each in a few classes."""
    text = block.text
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 60 else 4
    share = min(1.0, block.linked / len(text))
    link = 0 if share < 0.05 else 1 if share < 0.5 else 2
    last = text[-1]
    ending = "stop" if last in ".!?…" else "other"
    mark = "©" in text
    where = 0 if place < total * 0.15 else 2 if place >= total * 0.85 else 1
    return size, link, ending, mark, where, "|" in text or "»" in text or "·" in text


def text_features(key: tuple) -> list[str]:
    size, link, ending, mark, where, bars = key
    return [
        f"size:{size}", f"link:{link}", f"end:{ending}", f"copy:{mark}", f"where:{where}", f"bars:{bars}",
        f"size:{size}:link:{link}", f"size:{size}:end:{ending}",
    ]


# --- the field ------------------------------------------------------------------


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, ridge: float = 1e-5):
    """Weights ``{feature: w}`` of label 1 against 0, and the 2x2 transitions, by
    Adam on the conditional likelihood (forward-backward over all pages at once)."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index))
    n, longest = len(pages), max((len(p[0]) for p in pages), default=0)
    if not n:
        return {}, np.zeros((2, 2))
    lengths = np.array([len(p[0]) for p in pages])
    ids = np.array([index[f] for rows, _ in pages for row in rows for f in row])
    sizes = np.array([len(row) for rows, _ in pages for row in rows])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    page = np.repeat(np.arange(n), lengths)
    step_of = np.concatenate([np.arange(k) for k in lengths])
    gold = np.array([y for _, ys in pages for y in ys])
    inside = np.zeros((longest, n), dtype=bool)
    inside[step_of, page] = True
    gold_at = np.zeros((longest, n), dtype=np.int64)
    gold_at[step_of, page] = gold
    both = inside[1:] & inside[:-1]
    pair_gold = np.zeros((2, 2))
    np.add.at(pair_gold, (gold_at[:-1][both], gold_at[1:][both]), 1)
    theta = np.zeros(len(index) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for t in range(1, steps + 1):
        move = theta[-4:].reshape(2, 2)
        emit = np.zeros((longest, n, 2))
        emit[step_of, page, 1] = np.add.reduceat(theta[ids], starts)
        ahead = np.zeros((longest, n, 2))
        ahead[0] = emit[0]
        for k in range(1, longest):
            nxt = _log_sum(ahead[k - 1][:, :, None] + move, 1) + emit[k]
            ahead[k] = np.where(inside[k][:, None], nxt, ahead[k - 1])
        back = np.zeros((longest, n, 2))
        for k in range(longest - 2, -1, -1):
            nxt = _log_sum(move + (emit[k + 1] + back[k + 1])[:, None, :], 2)
            back[k] = np.where(inside[k + 1][:, None], nxt, 0.0)
        total = _log_sum(ahead[lengths - 1, rows], 1)
        one = np.exp(ahead[step_of, page, 1] + back[step_of, page, 1] - total[page])
        pair = np.exp(
            ahead[:-1, :, :, None] + move + (emit[1:] + back[1:])[:, :, None, :] - total[None, :, None, None]
        )
        grad = np.empty_like(theta)
        grad[:-4] = np.bincount(ids, (one - gold)[owner], len(index))
        grad[-4:] = (pair[both].sum(axis=0) - pair_gold).reshape(-1)
        grad = grad / n + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return {f: float(theta[i]) for f, i in index.items()}, theta[-4:].reshape(2, 2)


def viterbi(scores: list[float], move: np.ndarray) -> list[int]:
    """Best labels for scores of label 1 (label 0 scores 0)."""
    (a, b), (c, d) = move.tolist()
    zero, one, back = 0.0, scores[0], []
    for s in scores[1:]:
        from_zero, to_one = zero + a >= one + c, one + d >= zero + b
        back.append((0 if from_zero else 1, 1 if to_one else 0))
        zero, one = (zero + a if from_zero else one + c), (one + d if to_one else zero + b) + s
    label = int(one > zero)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


# --- labelled pages ---------------------------------------------------------------

#: Page frames: for each part of a page the elements it may stand in, with common class names. Fixed values.
FRAMES = {
    "header": ("header", "div.header", "div.masthead", "div.site-header", "div.topbar", "div.branding"),
    "menu": ("nav", "nav.menu", "div.nav", "div.navbar", "div.menu", "ul.navigation", "div.breadcrumb", "div.breadcrumbs",
             "ul.pagination", "div.tabs"),
    "side": ("aside", "aside.sidebar", "div.sidebar", "div.widget", "div.related", "section.recommended", "div.popular",
             "div.trending", "div.rail", "section.more", "div.toc", "div.author-bio", "div.tags"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "aside.promo", "div.banner",
               "section.promotion", "div.sponsor"),
    "notice": ("div.cookie", "div.cookie-notice", "div.cookie-banner", "div.consent", "div.notice", "div.gdpr",
               "div.alert", "div.popup", "div.modal", "div.newsletter", "div.subscribe", "div.paywall", "div.disclaimer",
               "section.privacy", "dialog", "div.overlay"),
    "form": ("form", "form.search", "form.login", "form.signup", "div.search", "form.comment-form", "form.subscribe"),
    "share": ("div.share", "ul.social", "div.social-links", "div.sharing", "div.meta", "div.byline", "div.follow"),
    "article": ("article", "article.post", "main", "main.content", "div.content", "div.article", "div.article-body",
                "div.post-content", "div.entry-content", "div.story", "section.body", "div.text", "div.main", "div", "section"),
    "comments": ("section.comments", "div.comments", "div.comment-list", "ol.comments", "div.comment", "div.replies",
                 "section.responses", "div.discussion", "div.feedback", "aside.comments", "div.reader-comments",
                 "section.reviews", "div.thread", "div.disqus"),
    "footer": ("footer", "footer.footer", "div.footer", "div.site-footer", "div.copyright", "div.legal", "div.bottom",
               "div.colophon"),
}
_MARKED = frozenset(["article", "main"])
_BESIDE = frozenset(["nav", "aside", "footer", "header", "form", "menu"])


def label(block: Block) -> int:
    """1 for blocks that the page's own markup has as article text."""
    inside = False
    for tag, names in block.path:
        inside |= tag in _MARKED or "articlebody" in "".join(names)
        if tag in _BESIDE or "comment" in names or "comments" in names:
            return 0
    return int(inside)


def _element(spec: str) -> tuple[str, tuple[str, ...]]:
    tag, _, names = spec.partition(".")
    return tag, tuple(names.split("-")) if names else ()


def reframed(texts: list[Block], others: list[Block], pool: list[str], rng: random.Random):
    """The article blocks ``texts`` in a random frame; rows of features, labels."""
    body = (("html", ()), ("body", ()))
    wrap = rng.choice(((), (("div", ("wrapper",)),), (("div", ("container",)),), (("div", ("page",)),), (("div", ()),)))
    out: list[tuple[Block, int]] = []

    def part(kind: str, chosen: list[tuple[str, int]], inner: tuple[str, ...], outer=(), positive: int = 0) -> None:
        path = body + wrap + outer + (_element(rng.choice(FRAMES[kind])),)
        for text, linked in chosen:
            tag = rng.choice(inner)
            out.append((Block(text, path + (((tag, ()),) if tag else ()), linked), positive))

    def some(low: int, high: int, link: float, short: bool) -> list[tuple[str, int]]:
        chosen = []
        for _ in range(rng.randint(low, high)):
            text = rng.choice(pool)
            if short:
                words = text.split()
                at = rng.randrange(len(words))
                text = " ".join(words[at : at + rng.randint(1, 9)])
            chosen.append((text, len(text) if rng.random() < link else 0))
        return chosen

    used = [(b.text, b.linked) for b in others] or some(1, 3, 0.3, True)
    if rng.random() < 0.6:
        part("notice", some(1, 3, 0.2, rng.random() < 0.5), ("p", "", "div", "button"))
    if rng.random() < 0.7:
        part("header", some(1, 3, 0.4, True), ("p", "h1", "div", "", "h2"))
    part("menu", some(2, 8, 0.9, True), ("li", "li", "", "p"))
    if rng.random() < 0.4:
        part("form", some(1, 3, 0.1, True), ("p", "label", "", "legend", "div"))
    if rng.random() < 0.5:
        part("side", some(1, 5, 0.6, rng.random() < 0.6), ("p", "li", "h3", "div"))
    if rng.random() < 0.5:
        part("advert", rng.sample(used, min(len(used), 2)), ("p", "", "div"))
    frame = _element(rng.choice(FRAMES["article"]))
    outer = rng.choice(((), (("main", ()),), (("div", ("content",)),), (("div", ("layout",)),)))
    if rng.random() < 0.3:
        part("share", some(1, 3, 0.5, True), ("p", "li", "", "div"), outer + (frame,) if rng.random() < 0.5 else outer)
    inset = rng.randrange(len(texts)) if rng.random() < 0.4 else -1
    for k, b in enumerate(texts):
        own = b.path[-1][0] if b.path else "p"
        own = rng.choice(("li", "li", "h2", "td", "blockquote", "div")) if rng.random() < 0.15 else own
        own = own if own in ("p", "h1", "h2", "h3", "li", "blockquote", "td", "pre", "figcaption") else "p"
        nest = (("ul", ()),) if own == "li" else (("table", ()), ("tr", ())) if own == "td" else ()
        out.append((Block(b.text, body + wrap + outer + (frame,) + nest + ((own, ()),), b.linked), 1))
        if k == inset:
            part(rng.choice(("advert", "side", "notice", "share")), some(1, 2, 0.3, rng.random() < 0.5), ("p", "", "div"), outer + (frame,))
    if rng.random() < 0.3:
        part("side", some(1, 6, 0.7, rng.random() < 0.6), ("p", "li", "h3", "div"), outer)
    if rng.random() < 0.6:
        near = rng.choice(((), outer, outer + (frame,)))
        part("comments", some(1, 6, 0.05, rng.random() < 0.3), ("p", "li", "div", "p"), near)
    if rng.random() < 0.3:
        part("form", some(1, 2, 0.1, True), ("p", "label", "", "div"))
    if rng.random() < 0.3:
        part("notice", some(1, 2, 0.2, rng.random() < 0.5), ("p", "", "div"))
    part("footer", rng.sample(used, min(len(used), 1)) + some(0, 2, 0.4, True), ("p", "", "li", "div"))
    return out


def _shortened(text: str, rng: random.Random) -> str:
    """At times a run of a few words: lists, captions and one-word lines are article text too."""
    if rng.random() < 0.65:
        return text
    words = text.split()
    at = rng.randrange(len(words))
    return " ".join(words[at : at + rng.randint(1, 9)])


def _rows(blocks: list[Block]) -> list[list[str]]:
    total = len(blocks)
    return [path_features(b.path) + text_features(text_key(b, k, total)) for k, b in enumerate(blocks)]


def training_set(pages: Iterable[str], seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    parsed = [blocks_of(p) for p in pages]
    labelled = [(bs, [label(b) for b in bs]) for bs in parsed]
    labelled = [(bs, ys) for bs, ys in labelled if any(ys)]
    pool = [b.text for bs, ys in labelled for b, y in zip(bs, ys) if y]
    own = bool(labelled)
    if not own:
        pool = [b.text for bs in parsed for b in bs if b.text.count(" ") >= 9]
        labelled = [([b for b in bs if b.text.count(" ") >= 9], None) for bs in parsed]
        labelled = [(bs, [1] * len(bs)) for bs, _ in labelled if bs]
    rng = random.Random(seed)
    out = []
    for bs, ys in labelled if own else []:
        out.append((_rows(bs), ys))
        short = [Block(_shortened(b.text, rng), b.path, 0) if y else b for b, y in zip(bs, ys)]
        out.append((_rows(short), ys))
    for _ in range(3 if own else 4):
        for bs, ys in labelled:
            texts = [Block(_shortened(b.text, rng), b.path, 0) for b, y in zip(bs, ys) if y]
            if own and rng.random() < 0.3:  # also short articles, without their heading
                texts = texts[1:][: rng.randint(1, 3)] or texts
            others = [b for b, y in zip(bs, ys) if not y]
            framed = reframed(texts, others, pool, rng)
            out.append((_rows([b for b, _ in framed]), [y for _, y in framed]))
    return out


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    weights, move = train(training_set(pdf.sort_values("rank")["html"]))
    names = [*weights, "move:00", "move:01", "move:10", "move:11"]
    return pd.DataFrame({"feature": names, "weight": [*weights.values(), *move.reshape(-1)]})


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_train: int = MAX_TRAIN) -> dict[str, float]:
    """Weights by feature, trained on at most ``max_train`` pages in one task."""
    rank = F.xxhash64(F.lit(9), F.col(id_col).cast("string"), F.col(html_col))
    sample = (
        pages.select(F.col(html_col).cast("string").alias("html"), rank.alias("rank"))
        .filter(F.length("html").between(1, MAX_TRAIN_CHARS))
        .orderBy("rank")
        .limit(max_train)
    )
    rows = sample.groupBy(F.lit(0).alias("one")).applyInPandas(_fit, "feature string, weight double").collect()
    return {r["feature"]: r["weight"] for r in rows}


class Extractor:
    """Decodes pages; remembers the score of each path and each class of text."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.move = np.array([[weights.get(f"move:{a}{b}", 0.0) for b in (0, 1)] for a in (0, 1)])
        self.paths: dict[tuple, float] = {}
        self.keys: dict[tuple, float] = {}

    def _score(self, block: Block, place: int, total: int) -> float:
        path = self.paths.get(block.path)
        if path is None:
            if len(self.paths) > 200_000:
                self.paths.clear()
            path = self.paths[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
        key = text_key(block, place, total)
        text = self.keys.get(key)
        if text is None:
            text = self.keys[key] = sum(self.weights.get(f, 0.0) for f in text_features(key))
        return path + text

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page or "")
        if not blocks:
            return ""
        total = len(blocks)
        labels = viterbi([self._score(b, k, total) for k, b in enumerate(blocks)], self.move)
        return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """``pages`` with columns ``text`` and ``n_chars`` in place of the html column."""
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(weights)
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("html"))
    schema = StructType(
        [f for f in rows.schema.fields if f.name != "html"]
        + [StructField("text", StringType()), StructField("n_chars", LongType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(shared.value)
        for batch in batches:
            texts = [extractor.text(p) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return rows.mapInArrow(run, schema)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    prepare(pages.sparkSession)
    return extract(pages.select("page_id", "url", "html"), fit(pages))


ship_by_value(__name__)
