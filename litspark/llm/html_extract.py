"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. A block is a vector: learned rows for
the tokens of its tag path (names, classes, ids), learned rows for its hashed
words, and its length, link share and end mark. A bidirectional LSTM in numpy
reads the whole sequence in both directions and labels every block as main text
or not; the page's text is its labelled blocks in order.

The labeller is trained here, in one task: on at most ``TRAIN_PAGES`` pages of the
table (a documented bound: of the pages whose layout names its parts those with
the smallest hash of their id). There, blocks inside an article or main element and outside of
navigation, advertisements and the like are main text. As layouts differ, every
page is learned from in several disguises: other names for the article's box or
none, other kinds of boilerplate put before, between and behind.

Defined cases: null or empty pages, and pages without a text block, have an
empty text; a page without markup is one block; unfinished tags and comments
run to the end of the page; repeated rows are returned each; if no page of the
table names its parts there is nothing to learn from, and all blocks of every
page are its text; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.common import slices, small_batches, table, text_of
from litspark.llm.html_blocks import Block, blocks_of
from litspark.llm.quality import trained_in_one_task

TRAIN_PAGES = 300
VARIANTS = 5
TAGS, WORDS = 1024, 2048      # rows of the two learned tables
TAG_DIMS, WORD_DIMS, EXTRA = 20, 6, 4
HIDDEN = 16
EPOCHS, BATCH, RATE = 8, 32, 0.01

# Words that name parts of a page, in tags, classes and ids.
MAIN_BOXES = ["article", "main", "div .content", "div .post", "div .article .body", "section .entry .content", "div .main .text",
              "div .story", "main .page", "div .post .content", "section .article", "div"]
OTHER_BOXES = ["nav", "nav .menu", "ul .menu", "div .navigation", "div .navbar", "header", "header .site .header", "div .header", "div .banner", "footer", "div .footer",
               "footer .site .footer", "aside", "aside .sidebar", "div .sidebar", "div .widget", "div .related", "div .notice", "div .cookie .notice",
               "div .cookie .banner", "div .alert", "div .consent", "div .popup", "div .ad", "div .ads", "div .advert", "div .advertisement",
               "div .sponsored", "div .promo", "form", "form .search", "form .newsletter", "div .subscribe", "div .share", "div .social",
               "div .comments", "section .comments", "div .comment", "ol .comment .list", "ul .comments", "div .replies", "div .reader .comments",
               "div .breadcrumb", "div .breadcrumbs", "div .copyright", "div .login", "div .pagination", "div .tags", "select", "button", "div .toolbar"]
_MAIN = {"article", "main"}
_OTHER = {t for box in OTHER_BOXES for t in box.split()} - {"div", "section", "ul", "ol", ".list", ".site", ".reader"}
_PHRASES = ["we use cookies to improve this site", "accept all", "subscribe to our newsletter", "all rights reserved", "© 2024", "share this",
            "read more", "related articles", "posted by", "reply", "comments", "log in", "sign up", "advertisement", "sponsored", "home about contact"]


def _number(token: str, rows: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % rows


class Encoded:
    """Blocks of several pages as flat feature lists, page after page."""

    def __init__(self, pages: list[list[Block]]):
        tags, words, self.extra, tag_size, word_size = [], [], [], [], []
        for blocks in pages:
            for k, b in enumerate(blocks):
                own = list({_number(t, TAGS) for t in (*b.path, "<" + b.inner + ">")})
                some = list({_number(t, WORDS) for t in set(b.text.lower().split())})
                tags += own
                words += some
                tag_size.append(len(own))
                word_size.append(len(some))
                n = len(b.text)
                self.extra.append((np.log1p(n) / 8, min(b.linked / n, 1.0), float(b.text[-1] in ".!?…:;\"'»”)"), k / len(blocks)))
        self.size = np.array([len(p) for p in pages], np.int64)
        self.tags, self.words = np.array(tags, np.int64), np.array(words, np.int64)
        self.tag_first = np.concatenate([[0], np.cumsum(tag_size)]).astype(np.int64)
        self.word_first = np.concatenate([[0], np.cumsum(word_size)]).astype(np.int64)
        self.extra = np.array(self.extra).reshape(-1, EXTRA)


def _segment_sum(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
    return total[first[1:]] - total[first[:-1]]


class Labeller:
    """Parameters and the two passes of the network."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        inputs = TAG_DIMS + WORD_DIMS + EXTRA
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"tags": rng.normal(0, 0.3, (TAGS, TAG_DIMS)), "words": rng.normal(0, 0.3, (WORDS, WORD_DIMS)), "out": draw(2 * HIDDEN, 1), "skip": draw(inputs, 1), "bias": np.zeros(1)}
        for way in ("f", "b"):
            self.p[way + "x"], self.p[way + "h"], self.p[way + "c"] = draw(inputs, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN)
            self.p[way + "c"][HIDDEN:2 * HIDDEN] = 1.0  # remember at first

    def inputs(self, e: Encoded) -> np.ndarray:
        scale = 1 / np.sqrt(np.maximum(np.diff(e.word_first), 1))[:, None]
        return np.concatenate([_segment_sum(self.p["tags"][e.tags], e.tag_first) / 2, _segment_sum(self.p["words"][e.words], e.word_first) * scale, e.extra], axis=1)

    def _lstm(self, x: np.ndarray, way: str, live: np.ndarray, keep: list | None) -> np.ndarray:
        """x: time x pages x inputs. ``live``: 0 behind a page's end, where the state is held at zero."""
        steps, n, _ = x.shape
        h, c, out = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((steps, n, HIDDEN))
        pre = x @ self.p[way + "x"] + self.p[way + "c"]
        for t in range(steps):
            z = pre[t] + h @ self.p[way + "h"]
            g = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
            u = np.tanh(z[:, 3 * HIDDEN:])
            before, prior = c, h
            c = (f * c + i * u) * live[t][:, None]
            h = o * np.tanh(c)
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, u, before, c, prior))
        return out

    def _lstm_back(self, x: np.ndarray, way: str, live: np.ndarray, keep: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        steps, n, _ = x.shape
        dz_all = np.zeros((steps, n, 4 * HIDDEN))
        dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        for t in range(steps - 1, -1, -1):
            i, f, o, u, before, c, prior = keep[t]
            dh = dh + dout[t]
            s = np.tanh(c)
            dc = (dc + dh * o * (1 - s * s)) * live[t][:, None]
            dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            dz_all[t] = dz
            grad[way + "h"] += prior.T @ dz
            dh, dc = dz @ self.p[way + "h"].T, dc * f
        flat, xs = dz_all.reshape(-1, 4 * HIDDEN), x.reshape(-1, x.shape[2])
        grad[way + "x"] += xs.T @ flat
        grad[way + "c"] += flat.sum(0)
        return dz_all @ self.p[way + "x"].T

    def _padded(self, e: Encoded, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The blocks as time x pages, forwards and backwards, and where each went."""
        steps, n = int(e.size.max(initial=0)), len(e.size)
        page = np.repeat(np.arange(n), e.size)
        t = np.arange(len(page)) - np.repeat(np.cumsum(e.size) - e.size, e.size)
        back = np.repeat(e.size, e.size) - 1 - t
        forwards, backwards = np.zeros((steps, n, flat.shape[1])), np.zeros((steps, n, flat.shape[1]))
        forwards[t, page], backwards[back, page] = flat, flat
        return forwards, backwards, (np.arange(steps)[:, None] < e.size).astype(float), (t, page), (back, page)

    def logits(self, e: Encoded) -> np.ndarray:
        flat = self.inputs(e)
        if not len(flat):
            return np.zeros(0)
        forwards, backwards, live, at, back = self._padded(e, flat)
        h = np.concatenate([self._lstm(forwards, "f", live, None)[at], self._lstm(backwards, "b", live, None)[back]], axis=1)
        return (h @ self.p["out"] + flat @ self.p["skip"] + self.p["bias"])[:, 0]

    def gradients(self, e: Encoded, target: np.ndarray) -> tuple[float, dict]:
        flat = self.inputs(e)
        forwards, backwards, live, at, back = self._padded(e, flat)
        keep_f, keep_b = [], []
        h = np.concatenate([self._lstm(forwards, "f", live, keep_f)[at], self._lstm(backwards, "b", live, keep_b)[back]], axis=1)
        z = (h @ self.p["out"] + flat @ self.p["skip"] + self.p["bias"])[:, 0]
        prob = 1 / (1 + np.exp(-z))
        d = ((prob - target) / len(target))[:, None]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["skip"], grad["bias"] = h.T @ d, flat.T @ d, d.sum(0)
        dh = d @ self.p["out"].T
        df, db = np.zeros((*live.shape, HIDDEN)), np.zeros((*live.shape, HIDDEN))
        df[at], db[back] = dh[:, :HIDDEN], dh[:, HIDDEN:]
        dflat = (self._lstm_back(forwards, "f", live, keep_f, df, grad)[at] + self._lstm_back(backwards, "b", live, keep_b, db, grad)[back]
                 + d @ self.p["skip"].T)
        np.add.at(grad["tags"], e.tags, np.repeat(dflat[:, :TAG_DIMS] / 2, np.diff(e.tag_first), axis=0))
        scale = 1 / np.sqrt(np.maximum(np.diff(e.word_first), 1))[:, None]
        np.add.at(grad["words"], e.words, np.repeat(dflat[:, TAG_DIMS:TAG_DIMS + WORD_DIMS] * scale, np.diff(e.word_first), axis=0))
        loss = -np.mean(np.log(np.where(target == 1, prob, 1 - prob) + 1e-12))
        return float(loss), grad


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """Whether each block is main text, for a page whose layout says so."""
    inside = np.array([bool(_MAIN & set(b.path)) for b in blocks])
    apart = np.array([bool(_OTHER & set(b.path)) for b in blocks])
    return (inside & ~apart).astype(float) if inside.any() else None


def _block(path: tuple[str, ...], text: str, linked: int) -> Block:
    return Block(tuple(dict.fromkeys(path)), text, linked, path[-1])


def _disguised(blocks: list[Block], label: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page as another layout would show it: the article's box under another
    name, and boilerplate of several kinds around and inside it."""
    def boiler(kind: str, prefix: tuple[str, ...]) -> list[Block]:
        out = []
        for _ in range(int(rng.integers(1, 5))):
            source = blocks[rng.integers(len(blocks))].text.split()
            text = _PHRASES[rng.integers(len(_PHRASES))] if rng.random() < 0.3 else " ".join(source[:int(rng.integers(1, 60))])
            inner = [("p",), ("li", "a"), ("ul", "li", "a"), (), ("div",), ("span",), ("h3",), ("li", "p")][rng.integers(8)]
            out.append(_block((*prefix, *kind.split(), *inner), text, len(text) if "a" in inner else 0))
        return out

    box = tuple(MAIN_BOXES[rng.integers(len(MAIN_BOXES))].split())
    outer = ("html", "body", *[(), ("div",), ("div", ".wrapper"), ("div", ".container"), ("div", ".page")][rng.integers(5)])
    new, marks, started = [], [], False
    kinds = [OTHER_BOXES[k] for k in rng.choice(len(OTHER_BOXES), 6, replace=False)]
    for k in kinds[:int(rng.integers(1, 3))]:
        some = boiler(k, outer)
        new, marks = new + some, marks + [0.0] * len(some)
    for b, y in zip(blocks, label):
        if y:
            at = max((k for k, t in enumerate(b.path) if t in _MAIN), default=-1)
            inner = tuple(t for t in b.path[at + 1:])
            if started and rng.random() < 0.12:  # boilerplate in the midst of the article
                some = boiler(kinds[5], (*outer, *box))
                new, marks = new + some, marks + [0.0] * len(some)
            if rng.random() < 0.08:
                inner = [("blockquote", "p"), ("ul", "li"), ("h2",), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("p", "a")][rng.integers(7)]
            new.append(_block((*outer, *box, *inner), b.text, b.linked))
            started = True
        elif rng.random() < 0.7:
            new.append(b)
        else:
            continue
        marks.append(float(y))
    for k in kinds[2:2 + int(rng.integers(1, 4))]:
        some = boiler(k, outer if rng.random() < 0.6 else (*outer, *box))
        new, marks = new + some, marks + [0.0] * len(some)
    return new, np.array(marks)


def train(pages: list[str], seed: int = 1) -> Labeller:
    rng = np.random.default_rng(seed)
    examples = []
    for page in pages:
        blocks = blocks_of(page)
        label = weak_labels(blocks) if blocks else None
        if label is not None:
            examples.append((blocks, label))
            examples += [_disguised(blocks, label, rng) for _ in range(VARIANTS)]
    net = Labeller(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(examples))
        for k in range(0, len(order), BATCH):
            some = [examples[i] for i in order[k:k + BATCH]]
            _, grad = net.gradients(Encoded([b for b, _ in some]), np.concatenate([y for _, y in some]))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for name, g in grad.items():  # steps scaled by the gradients' running moments
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                net.p[name] -= rate * (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(square[name] / (1 - 0.999 ** step)) + 1e-8)
    return net


#: How a page is written whose layout names its main part.
USABLE = r"(?i)<(article|main)[\s>/]"


def _train_pages(rows: pa.Table) -> list[np.ndarray]:
    """The network's parameters, none if no page names its parts."""
    pages = rows["text"].to_pylist()
    usable = [p for p in pages if (blocks := blocks_of(p)) and weak_labels(blocks) is not None]
    return [*train(usable).p.values()] if usable else []


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", rows: int = TRAIN_PAGES) -> Labeller | None:
    """A network trained in one task on at most ``rows`` pages: of those whose
    layout names its parts, the ones with the smallest hash of their id (of pages
    that share an id, the least text). None if there is no such page."""
    key = F.xxhash64(id_col, F.lit(2)).alias("key")
    usable = pages.filter(text_of(html_col).rlike(USABLE))
    chosen = usable.select(key).distinct().orderBy("key").limit(rows)  # keys only; their pages are fetched after
    some = usable.select(key, text_of(html_col).alias("text")).join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"))
    found = trained_in_one_task(some.select("key", F.lit(1).alias("label"), "text"), _train_pages)
    if not found:
        return None
    net = Labeller()
    net.p = {name: x.reshape(old.shape) for (name, old), x in zip(net.p.items(), found)}
    return net


def labelled_text(pages: list[str], net: Labeller | None) -> list[str]:
    """The main text of each page; pages of like length share a pass. Without a
    network every block is kept."""
    parsed = [blocks_of(p) for p in pages]
    if net is None:
        return [" ".join(b.text for b in blocks) for blocks in parsed]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(parsed)) if parsed[k]), key=lambda k: len(parsed[k]))
    for a in range(0, len(order), 64):
        some = order[a:a + 64]
        z = net.logits(Encoded([parsed[k] for k in some]))
        at = 0
        for k in some:
            own = z[at:at + len(parsed[k])]
            at += len(parsed[k])
            out[k] = " ".join(b.text for b, s in zip(parsed[k], own) if s >= 0)
    return out


def _extractor(net: Labeller | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "html"):
            text = labelled_text(batch.column(2).to_pylist(), net)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, net: Labeller | None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    small_batches(pages.sparkSession)
    return (pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
            .mapInArrow(_extractor(net), "page_id bigint, url string, text string, n_chars bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages))


SQL = None
