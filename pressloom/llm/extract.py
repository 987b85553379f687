"""Main-text extraction: a bidirectional LSTM in numpy labels the leaf blocks of a page.

A page becomes the sequence of its text blocks (text between block-level tags).  A block
is described by hashed tokens of its tag path (tags, classes, ids, roles), hashed words,
and a few counts; the network reads the whole sequence in both directions, so a block's
label depends on the document around it.  The network is trained here, on seeded pages
made by ``sample_page`` (a rule, not data), and sent to the tasks; its size is fixed.

Defined cases: null and empty html give an empty text; broken markup is read as far as
it goes (unclosed tags, stray closing tags, a missing end); scripts, styles, comments and
other raw text elements are never blocks; math is inline text, and a noscript, template or svg
without its end hides nothing; a page of any length and depth is read whole; repeated rows
repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.columns import word_hashes

BLOCK = frozenset(
    "html head body title p div section article main nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hr option select button label legend iframe video audio canvas menu dialog".split()
)
RAW = frozenset("script style noscript template textarea svg".split())
#: Without an end tag these hide nothing: their contents are read as if the start tag stood alone.
OPEN_ENDED = frozenset("noscript template svg".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
CLOSES = {  # a new element ends an open one of these
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = BLOCK - {"html", "head", "body", "title", "option", "label", "button", "iframe", "video", "audio", "canvas"}
#: A quote opens a quoted value right behind an equals sign only; elsewhere it is a plain character.
TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>=]|=[ \t\n\r\f]*"[^"]*(?:"|$)|=[ \t\n\r\f]*'[^']*(?:'|$)|=)*)(?:>|$)|<[!?][^>]*(?:>|$)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PATH_BITS, WORD_BITS, PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 11, 11, 12, 6, 8, 16
INPUT = PATH_DIM + WORD_DIM + NUMBERS


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path tokens, characters inside links) of every text block in page order."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(page)
    endless: set[str] = set()  # elements that have no further end tag

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, tuple(t for _, tokens in stack for t in tokens), min(linked, len(text))))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html_lib.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text)

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            if m[3].endswith("/"):
                continue
            end = None if name in endless else re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in OPEN_ENDED:
                endless.add(name)
            else:
                at = n
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = not closing
        elif name in BLOCK:
            flush()
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                ends = CLOSES.get(name, frozenset()) | ({"p"} if name in ENDS_P else set())
                while stack and stack[-1][0] in ends:
                    stack.pop()
                if name not in VOID:
                    named = " ".join("".join(g) for g in NAMED.findall(m[3])) if m[3] else ""
                    stack.append((name, (name, *(f".{t}" for t in re.findall(r"[a-z]+|\d+", named.lower())))))
    flush()
    return out


def _bucket(token: str) -> int:
    h = 2166136261
    for b in token.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ h >> 15) & ((1 << PATH_BITS) - 1)


_buckets: dict[str, int] = {}


def describe(found: list[tuple[str, tuple[str, ...], int]]) -> tuple:
    """Path buckets and their blocks, word buckets and their blocks, and the counts of each block."""
    path, path_of = [], []
    for i, (_, tokens, _) in enumerate(found):
        for t in tokens:
            b = _buckets.get(t)
            if b is None:
                if len(_buckets) > 100_000:
                    _buckets.clear()
                b = _buckets[t] = _bucket(t)
            path.append(b)
            path_of.append(i)
    texts = [t.encode() for t, _, _ in found]
    data = np.frombuffer(b"".join(texts), np.uint8)
    codes, first = word_hashes(data, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))
    words = (codes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    n_words = np.diff(first)
    size = np.array([len(t) for t, _, _ in found], np.float32)
    ends = np.array([t[-1] in ".!?\"”»…" for t, _, _ in found], np.float32)
    link = np.array([k for _, _, k in found], np.float32) / np.maximum(size, 1)
    n = len(found)
    place = np.arange(n) / max(1, n - 1)
    numbers = np.column_stack([np.log1p(size) / 5, np.log1p(n_words) / 4, ends, link, place, size > 25, size > 80, np.ones(n)]).astype(np.float32)
    return np.array(path, np.int64), np.array(path_of, np.int64), words, np.repeat(np.arange(n), n_words), numbers


class BlockLabeller:
    """Embeddings, a bidirectional LSTM and a logistic output."""

    def __init__(self, seed: int = 11):
        r = np.random.Generator(np.random.PCG64(seed))
        self.p = {
            "path": r.normal(0, 0.3, (1 << PATH_BITS, PATH_DIM)), "word": r.normal(0, 0.1, (1 << WORD_BITS, WORD_DIM)),
            "out": r.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1),
        }
        for d in "fb":
            self.p["w" + d] = r.normal(0, 0.15, (INPUT + HIDDEN, 4 * HIDDEN))
            self.p["g" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, described: tuple) -> np.ndarray:
        path, path_of, words, word_of, numbers = described
        n = len(numbers)
        x = np.zeros((n, INPUT), np.float32)
        for table, ids, of, a, b in (("path", path, path_of, 0, PATH_DIM), ("word", words, word_of, PATH_DIM, PATH_DIM + WORD_DIM)):
            if len(ids):
                count = np.maximum(np.bincount(of, minlength=n), 1)
                cuts = np.flatnonzero(np.r_[True, np.diff(of) > 0])
                x[of[cuts], a:b] = np.add.reduceat(self.p[table][ids], cuts, axis=0) / (np.sqrt(count) if table == "path" else count)[of[cuts], None]
        x[:, PATH_DIM + WORD_DIM :] = numbers
        return x

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction over x (pages, blocks, inputs)."""
        pages, steps, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((pages, steps, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = np.concatenate([x[:, t], h], axis=1)
            a = z @ self.p["w" + d] + self.p["g" + d]
            i, f, o = (1 / (1 + np.exp(-a[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, z, i, f, o, g, c, tc, m))
            c, h = np.where(m, c_new, c), np.where(m, o * tc, h)
            out[:, t] = h
        return out

    def odds(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return (both @ self.p["out"] + self.p["bias"])[:, :, 0]

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """True for the content blocks of each page."""
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        at = 0
        while at < len(order) and not pages[order[at]]:
            at += 1
        while at < len(order):
            rows = order[at : at + max(1, min(256, 40_000 // len(pages[order[at]])))]
            at += len(rows)
            x, mask = self.padded([self.inputs(describe(pages[k])) for k in rows])
            odds = self.odds(x, mask)
            for r, k in enumerate(rows):
                out[k] = odds[r, : len(pages[k])] > 0
        return out

    @staticmethod
    def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(r) for r in rows)
        x, mask = np.zeros((len(rows), steps, INPUT), np.float32), np.zeros((len(rows), steps), bool)
        for i, r in enumerate(rows):
            x[i, : len(r)], mask[i, : len(r)] = r, True
        return x, mask

    def gradients(self, batch: list[tuple[tuple, np.ndarray]]) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss over pages of (description, labels)."""
        x, mask = self.padded([self.inputs(d) for d, _ in batch])
        y = np.zeros(mask.shape, np.float32)
        for i, (_, labels) in enumerate(batch):
            y[i, : len(labels)] = labels
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        odds = (both @ self.p["out"] + self.p["bias"])[:, :, 0]
        d_odds = np.where(mask, 1 / (1 + np.exp(-odds)) - y, 0) / mask.sum()
        grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ d_odds.reshape(-1, 1), "bias": np.array([d_odds.sum()])}
        d_both = d_odds[:, :, None] * self.p["out"][:, 0]
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            w = self.p["w" + d]
            g_w, g_b = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            d_h, d_c = np.zeros((len(batch), HIDDEN), np.float32), np.zeros((len(batch), HIDDEN), np.float32)
            for t, z, i, f, o, g, c, tc, m in reversed(kept[d]):
                d_h = d_h + d_both[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                step_h = np.where(m, d_h, 0)
                step_c = np.where(m, d_c, 0) + step_h * o * (1 - tc**2)
                d_a = np.concatenate([step_c * g * i * (1 - i), step_c * c * f * (1 - f), step_h * tc * o * (1 - o), step_c * i * (1 - g**2)], axis=1)
                g_w += z.T @ d_a
                g_b += d_a.sum(axis=0)
                d_z = d_a @ w.T
                d_x[:, t] += d_z[:, :INPUT]
                d_h, d_c = np.where(m, d_z[:, INPUT:], d_h), np.where(m, step_c * f, d_c)
            grads |= {"w" + d: g_w, "g" + d: g_b}
        g_path, g_word = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        for i, (described, labels) in enumerate(batch):
            path, path_of, words, word_of, _ = described
            n, dx = len(labels), d_x[i]
            if len(path):
                np.add.at(g_path, path, (dx[:n, :PATH_DIM] / np.sqrt(np.maximum(np.bincount(path_of, minlength=n), 1))[:, None])[path_of])
            if len(words):
                np.add.at(g_word, words, (dx[:n, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(np.bincount(word_of, minlength=n), 1)[:, None])[word_of])
        return grads | {"path": g_path, "word": g_word}


def train_labeller(n_pages: int = 1800, epochs: int = 5, seed: int = 3, rate: float = 0.01) -> BlockLabeller:
    """A network trained on n_pages sample pages, the same on every run."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pages = []
    for _ in range(n_pages):
        found = blocks(sample_page(rng))
        labels = np.array([MAIN in t for t, _, _ in found], np.float32)
        pages.append((describe([(t.replace(MAIN, "").replace(REST, "") or "x", p, k) for t, p, k in found]), labels))
    model = BlockLabeller()
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(p) for k, p in model.p.items()}
    step = 0
    for _ in range(epochs):
        order = sorted(rng.permutation(n_pages).tolist(), key=lambda k: len(pages[k][1]) + 6 * rng.random())
        batches = [order[a : a + 24] for a in range(0, n_pages, 24)]
        for b in rng.permutation(len(batches)).tolist():
            step += 1
            for k, g in model.gradients([pages[i] for i in batches[b]]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


#: Marks that the sample pages carry in their texts; training removes them before a word is read.
MAIN, REST = "\ue000", "\ue001"


def sample_page(rng: np.random.Generator) -> str:
    """A page with an article among menus, adverts, notices, sidebars, forms, comments and so on."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: bool(rng.random() < p)
    syllables = ["".join(pick(*"bcdfghklmnprstvz", "th", "sh", "") + pick(*"aeiou", "é", "ü", "ion")) + pick("", "n", "r", "s") for _ in range(24)]
    tail = pick("", "", "", "%%", "***", "&amp;")

    def word() -> str:
        return "".join(pick(*syllables) for _ in range(int(rng.integers(1, 4)))) + (tail if tail and chance(0.5) else "")

    def sentences(low: int, high: int) -> str:
        out = []
        if high > 3 and chance(0.12):  # junk that belongs to a text: repeated words, numbers, addresses
            junk = [pick(word(), str(int(rng.integers(10**6))), f"{word()}@{word()}.org", f"https://{word()}.net/{word()}") for _ in range(int(rng.integers(1, 4)))]
            return " ".join(w for w in junk for _ in range(int(rng.integers(1, 40)))).capitalize() + pick("", ".")
        for _ in range(int(rng.integers(low, high + 1))):
            w = [word() for _ in range(int(rng.integers(1, 16)))]
            if chance(0.4):
                w[0] = f"<{(t := pick('b', 'i', 'em', 'strong', 'span', 'a href=/x'))}>{w[0]}</{t.split()[0]}>"
            out.append(" ".join(w).capitalize() + pick(".", ".", ".", "!", "?", ""))
        return " ".join(out)

    def noisy(kind: str) -> str:
        names = {
            "nav": ["nav", "menu", "navbar", "main-menu", "navigation", "top-links", "breadcrumb", "breadcrumbs"], "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "ad-slot"],
            "side": ["sidebar", "side", "related", "widget", "aside", "popular", "trending", "recommended"], "note": ["cookie", "notice", "consent", "alert", "gdpr", "cookie-banner", "popup", "newsletter", "subscribe"],
            "foot": ["footer", "site-footer", "bottom", "copyright", "legal"], "head": ["header", "masthead", "site-header", "top", "logo", "branding"],
            "talk": ["comments", "comment-list", "discussion", "responses", "replies", "respond", "reader-comments"], "main": ["content", "article", "post", "entry", "story", "article-body", "main", "post-content", "text", "body"], "share": ["share", "social", "tags", "byline", "meta", "toolbar"],
        }[kind]
        if chance(0.12):
            return f' class="c{int(rng.integers(99))}"'
        return f' {pick("class", "class", "id")}="{pick(*names)}{pick("", "", " wide", " x-" + str(int(rng.integers(9))))}"'

    rest = lambda t: f"{REST}{t}"
    main = lambda t: f"{MAIN}{t}"

    def nav() -> str:
        links = [f'<a href="/{k}">{rest(word())}</a>' for k in range(int(rng.integers(2, 10)))]
        body = "<ul>" + "".join(f"<li>{a}</li>" for a in links) + "</ul>" if chance(0.8) else " ".join(links)
        return f"<nav{noisy('nav') if chance(0.4) else ''}>{body}</nav>" if chance(0.6) else f"<div{noisy('nav')}>{body}</div>"

    def boxed(kind: str, tag: str, low: int, high: int) -> str:
        inner = sentences(low, high)
        inner = pick(rest(inner), f"<p>{rest(inner)}</p>", f"<h3>{rest(word())}</h3><p>{rest(inner)}</p>", "<ul>" + "".join(f"<li><a href=/>{rest(sentences(1, 1))}</a></li>" for _ in range(int(rng.integers(2, 7)))) + "</ul>" if kind == "side" else rest(inner))
        plain = tag != "div" and chance(0.5)
        return f"<{tag}{'' if plain else noisy(kind)}>{inner}</{tag}>"

    def form() -> str:
        rows = "".join(f"<label>{rest(word())}</label><input name=q>" for _ in range(int(rng.integers(1, 4))))
        return f"<form action=/s>{'<p>' + rest(sentences(1, 2)) + '</p>' if chance(0.4) else ''}{rows}<select><option>{rest(word())}</option><option>{rest(word())}</option></select><button>{rest(word())}</button></form>"

    def comments() -> str:
        one = lambda: pick(f"<div class=comment><b>{rest(word())}</b><p>{rest(sentences(1, 4))}</p></div>", f"<li class=\"comment\"><p>{rest(sentences(1, 4))}</p></li>", f"<article class=\"comment\"><h4>{rest(word())}</h4><p>{rest(sentences(1, 5))}</p></article>")
        tag = pick("div", "section", "ol")
        return f"<{tag}{noisy('talk').replace('class=' + chr(34) + 'c', 'class=' + chr(34) + 'comments c')}><h3>{rest(word())}</h3>{''.join(one() for _ in range(int(rng.integers(1, 6))))}{form() if chance(0.3) else ''}</{tag}>"

    def article() -> str:
        body = [f"<h1>{main(sentences(1, 1))}</h1>" if chance(0.85) else ""]
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            if r < 0.7:
                body.append(f"<p>{main(sentences(1, 6))}{pick('</p>', '</p>', '</p>', '')}")
            elif r < 0.78:
                body.append(f"<p><b>{main(sentences(1, 1))}<br>")
            elif r < 0.86:
                body.append(f"<h{(k := int(rng.integers(2, 5)))}>{main(sentences(1, 1))}</h{k}>")
            elif r < 0.91:
                body.append(f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{main(sentences(1, 2))}</li>" for _ in range(int(rng.integers(1, 5)))) + f"</{t}>")
            elif r < 0.95:
                body.append(pick(f"<blockquote>{main(sentences(1, 3))}</blockquote>", f"<blockquote><p>{main(sentences(1, 3))}</p></blockquote>", f"<pre>{main(sentences(1, 2))}</pre>", f"<table><tr><td>{main(word())}</td><td>{main(sentences(1, 1))}</td></tr></table>"))
            else:
                body.append(pick(boxed("ad", "div", 1, 2), boxed("share", "div", 1, 1), boxed("side", "aside", 1, 2)))
        inner = "".join(body)
        return pick(f"<article>{inner}</article>", f"<article{noisy('main')}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{noisy('main')}>{inner}</div>", f"<div{noisy('main')}><div>{inner}</div></div>", f"<section{noisy('main')}>{inner}</section>")

    before = [nav() if chance(0.85) else "", boxed("head", "header", 1, 1) if chance(0.35) else "", boxed("ad", "div", 1, 3) if chance(0.6) else "", boxed("note", "div", 1, 2) if chance(0.3) else "", form() if chance(0.15) else "", nav() if chance(0.2) else "", "<!-- ad 1 -->"]
    after = [boxed("ad", "div", 1, 2) if chance(0.25) else "", boxed("share", "div", 1, 1) if chance(0.2) else "", comments() if chance(0.35) else "", boxed("side", pick("aside", "aside", "div"), 1, 3) if chance(0.35) else "", form() if chance(0.15) else "", boxed("foot", pick("footer", "footer", "div"), 1, 2) if chance(0.85) else "", boxed("note", "div", 1, 2) if chance(0.2) else ""]
    side = boxed("side", pick("aside", "div"), 1, 3) if chance(0.2) else ""
    order = [*before, side, article(), *after] if chance(0.5) else [*before, article(), side, *after]
    body = "".join(order)
    if chance(0.2):
        body = f"<div id=page class=wrapper>{body}</div>"
    return f"<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>{rest(sentences(1, 1))}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{body}{pick('</body></html>', '</body></html>', '')}"


def main_text(pages: list[str], model: BlockLabeller) -> list[str]:
    found = [blocks(p) for p in pages]
    return [" ".join(b[0] for b, keep in zip(f, labels.tolist(), strict=True) if keep) for f, labels in zip(found, model.label(found), strict=True)]


def extract(pages: DataFrame, model: BlockLabeller, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The input without its html column, with the main text of each page."""
    from pyspark.sql import types as T

    sent = pages.sparkSession.sparkContext.broadcast(model)  # fixed size
    others = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.get_field_index(html_col))
            texts: list[str] = []
            for a in range(0, len(html), 512):
                texts += main_text([h or "" for h in html.slice(a, 512).to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(texts, pa.string())], names=[*others, text_col])

    schema = T.StructType([*(pages.schema[c] for c in others), T.StructField(text_col, T.StringType())])
    return pages.withColumn(html_col, F.col(html_col).cast("string")).mapInArrow(run, schema)
