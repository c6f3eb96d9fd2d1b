"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector of hashed tag-path parts, hashed words
and a few shares; a bidirectional LSTM in numpy reads the whole page and labels every block as main
text or not. It is trained here, on pages whose labels are known: real pages of a bounded sample with
an ``article`` or ``main`` element (inside it and outside menus, asides, forms and the like is main
text), and pages laid out from common templates with the sample's own words.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm.html_blocks import Block, blocks
from txnclean.llm.shared import sample_rows, table
from txnclean.llm.words import space_table, word_batches

#: Pages of the sample (those of the smallest hashes), and pages laid out from templates.
TRAIN_PAGES = 100
TRAIN_LAYOUTS = 480
PATHS, WORDS, SHARES = 192, 32, 6
HIDDEN = 16
EPOCHS = 8
SEED = 7

# fixed lists: names that pages commonly give to their parts
MAIN = ["article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "div class=article-body", "div class=story",
        "section class=article", "div role=main", "div class=post-body", "div id=main-content", "div itemprop=articleBody", "td"]
MAIN_BLOCKS = ["p"] * 8 + ["h1", "h2", "h3", "blockquote", "ul li", "ol li", "pre", "div", "p b", "p em", "table tr td", "dl dd", "section p", "figure figcaption"]
REST = [("nav ul", "li a"), ("nav", "a"), ("div class=menu", "ul li a"), ("ul class=navbar", "li a"), ("div id=navigation", "a"), ("ul class=breadcrumb", "li a"),
        ("header", "p"), ("header", "h1"), ("header", "a"), ("header", "div"), ("div class=header", "div"), ("div id=masthead", "h2"), ("div class=topbar", "span"),
        ("footer", "p"), ("footer", "div"), ("footer", ""), ("footer", "ul li a"), ("div class=footer", "p"), ("div id=footer", "a"), ("div class=copyright", "p"),
        ("aside", "p"), ("aside", "h3"), ("aside", "ul li a"), ("div class=sidebar", "p"), ("div class=sidebar", "h4"), ("div id=sidebar", "ul li"), ("div class=widget", "p"), ("div class=related", "ul li a"),
        ("div class=ad", ""), ("div class=ad", "p"), ("div class=ads", "p"), ("div class=advert", ""), ("div class=advertisement", "p"), ("div class=banner", "a"), ("div class=sponsored", "p"), ("div class=promo", "p"), ("section class=advert", "p"),
        ("div class=cookie-notice", "p"), ("div class=notice", "p"), ("div class=notice", ""), ("div class=cookie", ""), ("div class=consent", "p"), ("div class=alert", ""), ("div class=popup", "p"), ("div role=alert", "p"), ("div class=disclaimer", "p"), ("div id=gdpr", "p"),
        ("form", "label"), ("form", "p"), ("form", "button"), ("form", "div"), ("form", "select option"), ("form class=search", "label"), ("div class=newsletter", "p"), ("div class=subscribe", "form label"), ("div class=login", "form p"),
        ("section class=comments", "div class=comment p"), ("div class=comments", "p"), ("div id=comments", "div p"), ("ol class=commentlist", "li p"), ("ul class=comments", "li"), ("div class=comment", "p"), ("section id=comments", "article p"),
        ("div class=replies", "p"), ("div class=reviews", "p"), ("div class=share", "a"), ("div class=social", "ul li a"), ("div class=tags", "a"), ("div class=pagination", "a"), ("div class=toolbar", "button")]
NOT_MAIN_TAGS = frozenset("nav header footer aside form button select".split())
NOT_MAIN_NAMES = frozenset("ad ads advert advertisement banner sponsored promo menu navigation navbar breadcrumb sidebar widget related cookie notice consent popup alert footer copyright comments comment commentlist replies share social tags pagination newsletter subscribe login search".split())

_crc: dict[str, int] = {}


def _bucket(part: str, n: int) -> int:
    got = _crc.get(part)
    if got is None:
        if len(_crc) > 500_000:
            _crc.clear()
        got = _crc[part] = zlib.crc32(part.encode("utf-8", "surrogatepass"))
    return got % n


_path_vectors: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple) -> np.ndarray:
    got = _path_vectors.get(path)
    if got is None:
        got = np.zeros(PATHS, np.float32)
        for k, names in enumerate(path):
            for name in names:
                got[_bucket(name, PATHS)] = 1
        for names in path[-2:]:                       # the nearest tags again, as such
            got[_bucket("<" + names[0], PATHS)] = 1
        if len(_path_vectors) > 20_000:
            _path_vectors.clear()
        _path_vectors[path] = got
    return got


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page its blocks by features: hashed path parts, shares of hashed words, and six shares of the block."""
    every = [b for p in pages for b in p]
    out = np.zeros((len(every), PATHS + WORDS + SHARES), np.float32)
    if not every:
        return [out for _ in pages]
    texts = pa.array([b.text for b in every], pa.large_string())
    n_words = np.zeros(len(every))
    for lo, hi, w in word_batches(texts, space_table()):
        slot = w.doc() * WORDS + (w.hashes % np.uint64(WORDS)).astype(np.int64)
        bag = np.bincount(slot, minlength=(hi - lo) * WORDS).reshape(-1, WORDS)
        n_words[lo:hi] = np.maximum(1, w.counts())
        out[lo:hi, PATHS:PATHS + WORDS] = bag / n_words[lo:hi, None]
    out[:, :PATHS] = [_path_vector(b.path) for b in every]
    chars = np.array([len(b.text) for b in every])
    linked = np.array([b.linked for b in every])
    stops = np.array([b.text.count(".") + b.text.count(",") for b in every])
    depth = np.array([len(b.path) for b in every])
    size = np.array([len(p) for p in pages for _ in p])
    place = np.array([i for p in pages for i in range(len(p))])
    out[:, PATHS + WORDS:] = np.stack([np.sqrt(np.minimum(n_words, 400)) / 10, np.minimum(1, linked / np.maximum(1, chars)), np.minimum(1, stops / n_words),
                                       place / size, np.sqrt(np.minimum(size, 400)) / 20, depth / 10], 1)
    border = np.cumsum([0, *map(len, pages)])
    return [out[a:z] for a, z in zip(border, border[1:])]


# ---- the network ----

class Labeller:
    """A bidirectional LSTM with a logistic output per step; parameters in one dict of arrays."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @staticmethod
    def new(rng: np.random.Generator) -> "Labeller":
        d, h = PATHS + WORDS + SHARES, HIDDEN
        p = {}
        for side in "fb":
            p[f"x{side}"] = rng.normal(0, 0.1, (d, 4 * h))
            p[f"h{side}"] = rng.normal(0, 0.1, (h, 4 * h))
            p[f"c{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])     # forget gates start open
        p["o"], p["v"], p["z"] = rng.normal(0, 0.1, 2 * h), rng.normal(0, 0.05, d), np.zeros(1)
        return Labeller({k: v.astype(np.float32) for k, v in p.items()})

    def _walk(self, x: np.ndarray, on: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States of all steps (steps, pages, hidden) and what the way back needs."""
        steps, pages, _ = x.shape
        pre = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        h = np.zeros((pages, HIDDEN), np.float32)
        c, out, kept = h.copy(), np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = pre[t] + h @ self.p[f"h{side}"]
            s = 1 / (1 + np.exp(-g[:, :3 * HIDDEN]))
            i, f, o, a = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(g[:, 3 * HIDDEN:])
            m = on[t][:, None]
            c2 = m * (f * c + i * a)
            th = np.tanh(c2)
            h2 = m * (o * th)
            kept.append((t, h, c, i, f, o, a, th, m))
            h, c = h2, c2
            out[t] = h
        return out, kept

    def forward(self, x: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Chances (steps, pages) of main text. Steps past a page's end must stand off (on = 0)."""
        f, kf = self._walk(x, on, "f")
        b, kb = self._walk(x, on, "b")
        both = np.concatenate([f, b], 2)
        y = 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + x @ self.p["v"] + self.p["z"], -30, 30)))
        return y, (both, kf, kb)

    def gradients(self, x: np.ndarray, on: np.ndarray, want: np.ndarray) -> dict[str, np.ndarray]:
        y, (both, kf, kb) = self.forward(x, on)
        e = ((y - want) * on / on.sum()).astype(np.float32)
        flat = x.reshape(-1, x.shape[2])
        g = {"o": np.tensordot(e, both, ([0, 1], [0, 1])), "v": flat.T @ e.reshape(-1), "z": np.array([e.sum()])}
        back = e[:, :, None] * self.p["o"]
        for side, kept, part in (("f", kf, back[:, :, :HIDDEN]), ("b", kb, back[:, :, HIDDEN:])):
            dpre = np.zeros((*e.shape, 4 * HIDDEN), np.float32)
            dwh = np.zeros_like(self.p[f"h{side}"])
            dh = np.zeros((e.shape[1], HIDDEN), np.float32)
            dc = dh.copy()
            for t, h, c, i, f, o, a, th, m in reversed(kept):
                dht = (dh + part[t]) * m
                do = dht * th
                dct = dc * m + dht * o * (1 - th * th)
                d = np.concatenate([dct * a * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - a * a)], 1)
                dpre[t] = d
                dwh += h.T @ d
                dh, dc = d @ self.p[f"h{side}"].T, dct * f
            g[f"x{side}"], g[f"h{side}"], g[f"c{side}"] = flat.T @ dpre.reshape(-1, 4 * HIDDEN), dwh, dpre.sum((0, 1))
        return g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), PATHS + WORDS + SHARES), np.float32)
    on = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[:len(p), k], on[:len(p), k] = p, 1
    return x, on


def train(pages: list[tuple[np.ndarray, np.ndarray]]) -> Labeller:
    """Adam over batches of pages (features, labels)."""
    rng = np.random.default_rng(SEED)
    net = Labeller.new(rng)
    pages = [p for p in pages if len(p[1])]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for _ in range(EPOCHS):
        # pages of like length go together; ties and the order of the batches are drawn
        order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][1]) // 3)
        for lo in 24 * rng.permutation(-(-len(order) // 24)):
            some = [pages[i] for i in order[lo:lo + 24]]
            x, on = _padded([p[0][:200] for p in some])
            want = np.zeros_like(on)
            for k, (_, y) in enumerate(some):
                want[:len(y[:200]), k] = y[:200]
            step += 1
            for k, d in net.gradients(x, on, want).items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                net.p[k] = (net.p[k] - 0.015 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


# ---- training pages ----

def _taught(page: list[Block]) -> np.ndarray | None:
    """Labels of a page that says which part is its main text; None for others."""
    tags = [{n[0] for n in b.path} for b in page]
    if not any(t & {"article", "main"} for t in tags):
        return None
    names = [{w[1:] for n in b.path for w in n[1:]} for b in page]
    return np.array([bool(t & {"article", "main"}) and not t & NOT_MAIN_TAGS and not n & NOT_MAIN_NAMES for t, n in zip(tags, names)], np.float32)


def _element(spec: str, inner: str) -> str:
    """'div class=a li' around inner: tags, each with its attributes."""
    opened, closed = "", ""
    tags: list[list[str]] = []
    for word in spec.split():
        if "=" in word:
            tags[-1].append(word)
        else:
            tags.append([word])
    for t in tags:
        opened += f"<{t[0]}" + "".join(' {}="{}"'.format(*a.split("=")) for a in t[1:]) + ">"
        closed = f"</{t[0]}>" + closed
    return opened + inner + closed


def layouts(words: list[str], n: int) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Pages from the templates, with labels."""
    rnd = random.Random(SEED)
    words = words or ["word"]

    def text(least: int, most: int) -> str:
        return " ".join(rnd.choice(words) for _ in range(rnd.randint(least, most)))

    def rest() -> str:
        outer, inner = rnd.choice(REST)
        long = re.search("comment|repl|review|ad|notice|cookie|consent|promo|aside|side|footer", outer)
        n = rnd.randint(1, 6) if inner else 1
        body = [" ".join(f"\x01{w}" for w in text(1, rnd.choice([4, 12, 60]) if long else 5).split()) for _ in range(n)]
        return _element(outer, "".join(_element(inner, b) if inner else b for b in body))

    for _ in range(n):
        inside = "".join((rest() if rnd.random() < 0.08 else _element(rnd.choice(MAIN_BLOCKS), text(1, rnd.choice([3, 15, 60, 120])))) for _ in range(rnd.randint(1, 14)))
        before, after = ["".join(rest() for _ in range(rnd.randint(0, 4))) for _ in range(2)]
        main = _element(rnd.choice(MAIN), inside)
        wrap = rnd.choice(["", "", "div class=wrapper", "div id=page", "div class=container"])
        body = before + main + after
        page = blocks(f"<html><body>{_element(wrap, body) if wrap else body}</body></html>")
        y = np.array(["\x01" not in b.text for b in page], np.float32)
        for b in page:                                     # the mark says which text is not main
            b.text = b.text.replace("\x01", "") or "-"
        yield page, y


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> Labeller:
    """A labeller from at most TRAIN_PAGES pages and TRAIN_LAYOUTS layouts (also of an empty table)."""
    rows = sorted(sample_rows(pages.select(F.col(id_col).cast("string").alias("id"), F.coalesce(html_col, F.lit("")).alias("html")), TRAIN_PAGES).collect(),
                  key=lambda r: (r["id"] or "", r["html"]))
    real = [blocks(r["html"]) for r in rows]
    words = [w for p in real for b in p for w in b.text.split(" ")][:50_000]
    pairs = [(p, y) for p in real if (y := _taught(p)) is not None] + list(layouts(words, TRAIN_LAYOUTS))
    return train(list(zip(vectors([p for p, _ in pairs]), [y for _, y in pairs])))


def main_texts(net: Labeller, htmls: list[str]) -> list[str]:
    parsed = [blocks(h) for h in htmls]
    out = [""] * len(htmls)
    features = vectors(parsed)
    order = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
    for lo in range(0, len(order), 64):
        some = order[lo:lo + 64]
        x, on = _padded([features[i] for i in some])
        y, _ = net.forward(x, on)
        for k, i in enumerate(some):
            out[i] = "\n".join(b.text for b, c in zip(parsed[i], y[:, k]) if c >= 0.5)
    return out


def extract(pages: DataFrame, net: Labeller, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row's whole page.

    A null or empty page has an empty text. Null ids and repeated rows are kept as they are; other
    columns are ignored. Nothing is shuffled.
    """
    parameters = net.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(parameters)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = main_texts(own, [h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
