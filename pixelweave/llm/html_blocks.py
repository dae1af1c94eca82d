"""Main text of HTML pages by a recurrent block labeller.

A page becomes its sequence of leaves: the runs of text between the boundaries of block elements. Each leaf has a vector of
its tag path (hashed tags and class or id words of its open elements), of its hashed words, and of a few plain facts.
A bidirectional LSTM in numpy reads the whole sequence both ways, so every leaf is labelled with the context of the
document around it; leaves labelled as content are the text.

There are no labelled pages: the network is fitted on a bounded sample of the pages themselves, weakly labelled by their
own semantic elements, and on made pages of many layouts filled with the sample's text, whose labels are known.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textbytes

#: Bounds of the sample that the network is fitted on: pages, bytes of a page, and made pages.
SAMPLE_PAGES, SAMPLE_BYTES, MADE_PAGES = 200, 1 << 17, 500
PATH_DIMS, WORD_DIMS, PLAIN_DIMS, HIDDEN = 64, 16, 8, 16
ROUNDS = 10

#: Fixed values of HTML: elements whose bounds part blocks, whose content is no text, and that close an open element.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noframes".split())
#: Elements whose content is no text either, but only as far as their own end tag: an unclosed one is its start tag alone.
CLOSED = frozenset("object svg canvas audio video noscript template".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of class names and ids, and elements, that mark a part of a page as no content (for weak labels only).
NOT_CONTENT = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer form header login menu meta nav navbar navigation newsletter notice pagination pager popup promo related respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
NOT_ELEMENTS = frozenset("nav aside footer header form head title button select option label menu dialog fieldset search legend".split())

OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
GAP, ATTRIBUTE, EQUALS, UNQUOTED = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Open elements of a path that count, outermost and innermost; deeper ones between them don't.
OUTER, INNER = 32, 32
NAME = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Leaf:
    path: tuple[str, ...]  #: "tag" and "tag.word" of each open block element, outermost first
    text: str
    linked: float  #: share of its text in links


@dataclass
class Token:
    start: int
    end: int
    name: str = ""  #: of a tag, in lower case; empty for what is no tag
    closing: bool = False
    empty: bool = False  #: the tag ends with a slash
    attributes: tuple[tuple[str, str], ...] = ()
    text: str = ""  #: of a CDATA section


def _attributes(page: str, at: int, quotes: bool) -> tuple[list[tuple[str, str]], int] | None:
    """Attributes from ``at`` on, one after another, and where their tag ends; None if it doesn't.

    Only a quote right after an equals sign opens a value, which runs to the next such quote; any other is a character.
    """
    out: list[tuple[str, str]] = []
    while True:
        at = GAP.match(page, at).end()
        if at >= len(page):
            return None
        if page[at] == ">":
            return out, at + 1
        m = ATTRIBUTE.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        if m := EQUALS.match(page, at):
            at = m.end()
            if quotes and page[at : at + 1] in ('"', "'"):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                m = UNQUOTED.match(page, at)
                value, at = m[0], m.end()
        out.append((name, value))


def tokens(page: str) -> list[Token]:
    """Tags, comments, CDATA sections and raw elements in order, in time linear in the page; all between them is text.

    A tag that doesn't end, a quote that is never closed included, makes quotes plain characters from there on: each later
    tag ends at its first ``>``. What has no end even so is text. Raw elements reach to their end tag or the end of the page.
    """
    out: list[Token] = []
    at, quotes, drawings = 0, True, 0
    while m := OPEN.search(page, at):
        start, name = m.start(), (m[2] or "").lower()
        if not name:
            if m[0] == "<!--":
                at = page.find("-->", start + 2)
                at = len(page) if at < 0 else at + 3
                out.append(Token(start, at))
            elif m[0] == "<![CDATA[":
                end = page.find("]]>", m.end())
                end = len(page) if end < 0 else end
                at = min(end + 3, len(page))
                out.append(Token(start, at, text=page[m.end() : end]))
            else:
                at = page.find(">", start) + 1
                if not at:
                    break
                out.append(Token(start, at))
            continue
        found = _attributes(page, m.end(), quotes)
        if found is None and quotes:
            quotes = False
            found = _attributes(page, m.end(), quotes)
        if found is None:
            break
        attributes, at = found
        empty = page[at - 2] == "/"
        drawings = max(drawings + (-1 if m[1] else not empty), 0) if name == "svg" else drawings
        if name in RAW and not m[1] and not (empty and drawings):
            end = RAW_ENDS[name].search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or len(page)
            name = ""
        out.append(Token(start, at, name, bool(m[1]), empty, tuple(attributes)))
    return out


def _without_text(found: list[Token]) -> dict[int, int]:
    """Place of the start tag of each closed element of CLOSED → of its end tag; each end tag ends the last open start tag of its name."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, t in enumerate(found):
        if t.name not in CLOSED:
            continue
        if t.closing:
            if open_.get(t.name):
                out[open_[t.name].pop()] = k
        elif t.name == "svg" and t.empty:
            out[k] = k
        else:
            open_.setdefault(t.name, []).append(k)
    return out


def _names(attributes: tuple[tuple[str, str], ...]) -> list[str]:
    out = []
    for kind, value in attributes:
        low = value.lower()
        if kind in ("hidden", "aria-hidden", "style"):
            if kind == "hidden" or low == "true" or "display:none" in low.replace(" ", ""):
                out.append("hidden")
        elif kind in ("class", "id", "role"):
            out += NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return out


def leaves(page: str) -> list[Leaf]:
    """The leaves of a page in order, in linear time; unclosed, crossing and unknown tags are borne as browsers bear them."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_: dict[str, int] = {}
    buffer: list[str] = []
    size = linked = in_link = at = 0

    def add(piece: str) -> None:
        nonlocal size, linked
        if piece:
            buffer.append(piece)
            size += len(piece)
            linked += len(piece) if in_link else 0

    def flush() -> None:
        nonlocal size, linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                counted = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
                out.append(Leaf(tuple(x for _, names in counted for x in names), text, linked / max(size, 1)))
            buffer.clear()
        size = linked = 0

    def pop() -> str:
        tag, _ = stack.pop()
        open_[tag] -= 1
        return tag

    found = tokens(page)
    spans = _without_text(found)
    k = 0
    while k < len(found):
        t = found[k]
        add(page[at : t.start])
        k += 1
        at = t.end
        if not t.name:
            if t.text:
                buffer.append(t.text)
            continue
        tag = t.name
        if tag in CLOSED and not t.closing:
            if k - 1 in spans:
                k = spans[k - 1] + 1
                at = found[k - 1].end
            continue
        if tag == "a":
            in_link = 0 if t.closing else 1
        if tag == "br":
            buffer.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if t.closing:
            while open_.get(tag) and pop() != tag:
                pass
            in_link = 0
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p" and tag not in ("button", "label", "option", "select"):
            pop()
        shut = CLOSES.get(tag)
        while shut and stack and stack[-1][0] in shut:
            pop()
        stack.append((tag, (tag, *(f"{tag}.{w}" for w in _names(t.attributes)))))
        open_[tag] = open_.get(tag, 0) + 1
    add(page[at:])
    flush()
    return out


_path_vectors: dict[tuple[str, ...], np.ndarray] = {}


def _hash(text: str) -> int:
    value = 0xCBF29CE484222325
    for b in text.encode():
        value = ((value ^ b) * 0x100000001B3) & (1 << 64) - 1
    return value ^ value >> 31


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tags, and words without their tag; the innermost element counts once more."""
    v = _path_vectors.get(path)
    if v is None:
        v = np.zeros(PATH_DIMS, np.float32)
        inner = max((k for k, x in enumerate(path) if "." not in x), default=0)
        for k, x in enumerate(path):
            for name in ((x,) if "." not in x else (x, "." + x.partition(".")[2])):
                h = _hash(name)
                v[h % PATH_DIMS] += 1 if h >> 40 & 1 else -1
            if k >= inner:
                h = _hash("in:" + x)
                v[h % PATH_DIMS] += 1 if h >> 40 & 1 else -1
        v = np.clip(v, -3, 3)
        if len(_path_vectors) > 20_000:
            _path_vectors.clear()
        _path_vectors[path] = v
    return v


def vectors(items: list[Leaf], at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Vectors of leaves; ``at`` and ``of``: each one's place in its page and the page's number of leaves."""
    n = len(items)
    texts = [x.text.encode("utf-8", "replace") for x in items]
    sizes = np.array([len(t) for t in texts])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    words, count = np.zeros((n, WORD_DIMS), np.float32), np.zeros(n)
    for a, b in common.row_chunks(offsets):
        rows, hashes, _, _ = textbytes.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        cell = rows * WORD_DIMS + (hashes % np.uint64(WORD_DIMS)).astype(np.int64)
        sign = np.where(hashes >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        words[a:b] = np.bincount(cell, sign, minlength=(b - a) * WORD_DIMS).reshape(b - a, WORD_DIMS)
        count[a:b] = np.bincount(rows, minlength=b - a)
    # a block of thousands of words, or of one word many times, looks like other long ones
    words = np.clip(words / np.maximum(np.sqrt(count), 1)[:, None], -3, 3).astype(np.float32)
    ends = np.array([x.text[-1] in ".!?…。" for x in items], np.float32)
    plain = np.stack([np.log1p(np.minimum(count, 100)) / 4, np.array([x.linked for x in items]), ends, at / np.maximum(of, 1), np.minimum(at, 10) / 10, np.minimum(of - at, 10) / 10, np.array([x.text.count(",") for x in items]) / np.maximum(count, 1), np.array(["©" in x.text for x in items])], axis=1)
    return np.concatenate([np.array([path_vector(x.path) for x in items]), words, plain.astype(np.float32)], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class BiLstm:
    """One layer each way, a logistic output on both hidden states. Sequences are padded; (time, batch, dims)."""

    def __init__(self, seed: int = 0, dims: int = PATH_DIMS + WORD_DIMS + PLAIN_DIMS, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p[f"w{way}"] = (rng.standard_normal((dims, 4 * hidden)) / np.sqrt(dims)).astype(np.float32)
            self.p[f"u{way}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p[f"c{way}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["v"] = (rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def _way(self, x, mask, way, learn=True):
        t, n, h = len(x), x.shape[1], self.hidden
        gates = x.reshape(t * n, -1) @ self.p[f"w{way}"] + self.p[f"c{way}"]
        gates = gates.reshape(t, n, -1)
        state, out = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        kept = np.zeros((t, n, h), np.float32)
        steps = []
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            g = gates[k] + out @ self.p[f"u{way}"]
            i, f, o = sigmoid(g[:, :h]), sigmoid(g[:, h : 2 * h]), sigmoid(g[:, 2 * h : 3 * h])
            c = np.tanh(g[:, 3 * h :])
            new = f * state + i * c
            th = np.tanh(new)
            m = mask[k][:, None]
            if learn:
                steps.append((k, i, f, o, c, state, th, out, m))
            state, out = np.where(m, new, state), np.where(m, o * th, out)
            kept[k] = out
        return kept, steps

    def forward(self, x, mask, learn=True):
        """Probabilities, hidden states, and what learning needs of each step (nothing without ``learn``)."""
        hf, sf = self._way(x, mask, "f", learn)
        hb, sb = self._way(x, mask, "b", learn)
        both = np.concatenate([hf, hb], axis=2)
        return sigmoid(both @ self.p["v"] + self.p["d"][0]), both, sf, sb

    def gradients(self, x, mask, target):
        p, both, sf, sb = self.forward(x, mask)
        h, total = self.hidden, max(mask.sum(), 1)
        dz = np.where(mask, p - target, 0).astype(np.float32) / np.float32(total)
        g = {"v": np.einsum("tn,tnh->h", dz, both), "d": np.array([dz.sum()], np.float32)}
        dboth = dz[:, :, None] * self.p["v"]
        for way, steps, dh in (("f", sf, dboth[:, :, :h]), ("b", sb, dboth[:, :, h:])):
            dgates = np.zeros((len(x), x.shape[1], 4 * h), np.float32)
            du = np.zeros_like(self.p[f"u{way}"])
            dstate, dout = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for k, i, f, o, c, state, th, before, m in reversed(steps):
                d = dout + dh[k]
                here = np.where(m, d, 0)
                ds = np.where(m, dstate + here * o * (1 - th * th), 0)
                dg = np.concatenate([ds * c * i * (1 - i), ds * state * f * (1 - f), here * th * o * (1 - o), ds * i * (1 - c * c)], axis=1)
                dgates[k] = dg
                du += before.T @ dg
                dout = np.where(m, 0, d) + dg @ self.p[f"u{way}"].T
                dstate = np.where(m, ds * f, dstate)
            g[f"u{way}"] = du
            g[f"w{way}"] = x.reshape(-1, x.shape[2]).T @ dgates.reshape(-1, 4 * h)
            g[f"c{way}"] = dgates.sum(axis=(0, 1))
        loss = float(-np.where(mask, np.where(target > 0.5, np.log(np.maximum(p, 1e-9)), np.log(np.maximum(1 - p, 1e-9))), 0).sum() / total)
        return g, loss

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = 0.01, batch: int = 24, seed: int = 0) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, loss = 0, 0.0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        for r in range(rounds):
            losses = []
            for k in rng.permutation(len(groups)):
                x, mask = pad([pages[j][0] for j in groups[k]])
                target = np.zeros(mask.shape, np.float32)
                for col, j in enumerate(groups[k]):
                    target[: len(pages[j][1]), col] = pages[j][1]
                g, loss = self.gradients(x, mask, target)
                losses.append(loss)
                step += 1
                for name, v in self.p.items():
                    grad = np.clip(g[name], -1, 1)
                    m[name] += 0.1 * (grad - m[name])
                    s[name] += 0.01 * (grad * grad - s[name])
                    v -= rate * (1 - 0.9 * r / rounds) * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)
            loss = float(np.mean(losses))
        return loss

    def label(self, pages: list[np.ndarray], batch: int = 128, cells: int = 60_000) -> list[np.ndarray]:
        """Probabilities of content for each leaf; pages of like lengths run together, in batches of bounded size."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < batch and len(pages[order[b]]) * (b - a + 1) <= cells:
                b += 1
            group = [k for k in order[a:b] if len(pages[k])]
            if group:
                p = self.forward(*pad([pages[k] for k in group]), learn=False)[0]
                for col, k in enumerate(group):
                    out[k] = p[: len(pages[k]), col]
            a = b
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def page_vectors(pages: list[list[Leaf]]) -> list[np.ndarray]:
    sizes = np.array([len(p) for p in pages], np.int64)
    if not sizes.sum():
        return [np.zeros((0, PATH_DIMS + WORD_DIMS + PLAIN_DIMS), np.float32)] * len(pages)
    at = np.arange(sizes.sum()) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return np.split(vectors([x for p in pages for x in p], at, np.repeat(sizes, sizes)), np.cumsum(sizes)[:-1])


def weak_labels(items: list[Leaf]) -> np.ndarray | None:
    """1 for leaves in an article or main element but not in a part that is named otherwise; None without such an element."""
    inside = [any(x in ("article", "main", "main.main") or x.endswith(".articlebody") for x in leaf.path) for leaf in items]
    if not any(inside):
        return None
    bad = [any(x in NOT_ELEMENTS or x.partition(".")[2] in NOT_CONTENT or x.partition(".")[2] == "hidden" for x in leaf.path) for leaf in items]
    return np.array([a and not b for a, b in zip(inside, bad, strict=True)], np.float32)


def made_page(rng: np.random.Generator, sentences: list[str]) -> tuple[str, list[str]]:
    """A page of a random layout filled with given text, and the texts of its content blocks."""

    def words(least: int, most: int) -> str:
        out: list[str] = []
        n = int(rng.integers(least, most))
        while len(out) < n:
            out += sentences[int(rng.integers(len(sentences)))].split()
        return html.escape(" ".join(out[:n]), quote=False)

    def pick(*values):
        return values[int(rng.integers(len(values)))]

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 4)}</a></li>' for k in range(n))

    content: list[str] = []

    def keep(tag: str, text: str) -> str:
        content.append(" ".join(html.unescape(text).split()))
        return f"<{tag}>{text}" + ("" if tag == "p" and rng.random() < 0.15 else f"</{tag}>")

    nav = pick("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="nav navbar">{}</ul>', '<div id="navigation"><ul>{}</ul></div>').format(links(int(rng.integers(3, 9))))
    advert = lambda: pick('<div class="ad">{}</div>', '<div class="advert banner">{}</div>', '<aside class="sponsored"><p>{}</p></aside>', '<div id="ads"><p>{}</p></div>').format(words(3, 15))
    notice = lambda: pick('<div class="cookie-notice"><p>{}</p><button>OK</button></div>', '<div id="consent-banner">{}</div>', '<div role="dialog" class="popup"><p>{}</p></div>', '<div class="notice">{}</div>').format(words(5, 25))
    form = lambda: pick('<form action="/s"><label>{}</label><input name="q"><button>{}</button></form>', '<form class="newsletter"><p>{}</p><button>{}</button></form>').format(words(2, 8), words(1, 3))
    side = lambda: pick('<aside><h3>{}</h3><ul>{}</ul></aside>', '<div class="sidebar"><h4>{}</h4><ul>{}</ul></div>', '<div class="related"><h3>{}</h3><ul>{}</ul></div>', '<section class="widget share"><p>{}</p><ul>{}</ul></section>').format(words(1, 4), links(int(rng.integers(2, 6))))
    n_comments = int(rng.integers(1, 5))
    remarks = "".join(pick('<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", '<article class="comment"><p>{}</p></article>').format(words(4, 40)) for _ in range(n_comments))
    comments = pick('<section id="comments"><h2>{}</h2>{}</section>', '<div class="comments"><h3>{}</h3>{}</div>', '<ol class="comment-list"><li>{}</li>{}</ol>').format(words(1, 3), remarks)
    header = pick("<header><p>{}</p></header>", '<div class="header"><h2>{}</h2></div>', '<header class="site"><a href="/">{}</a></header>').format(words(1, 5))
    footer = pick("<footer>&copy; {}</footer>", '<div class="footer"><p>{}</p></div>', '<footer><p>Copyright {}</p></footer>').format(words(2, 10))
    body = [keep(pick("h1", "h1", "h2"), words(3, 12))]
    for _ in range(int(rng.integers(0, 14))):
        kind = rng.random()
        if kind < 0.78:
            body.append(keep("p", words(1, 90)))
        elif kind < 0.84:
            body.append(keep(pick("h2", "h3"), words(1, 7)))
        elif kind < 0.9:
            body.append(pick("<ul>{}</ul>", "<ol>{}</ol>").format("".join(keep("li", words(2, 20)) for _ in range(int(rng.integers(2, 5))))))
        elif kind < 0.94:
            body.append(keep("blockquote", words(5, 30)))
        else:
            body.append(pick(advert, side, form)())
    shell = pick("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content"><div class="post entry">{}</div></div>', '<div class="article-body">{}</div>', "<div><div>{}</div></div>", "<section>{}</section>", '<div role="main">{}</div>')
    inner = "".join(body)
    if rng.random() < 0.25:
        inner += comments
        comments = ""
    parts = [x() for x in (notice, advert, form) if rng.random() < 0.35]
    before = [header] * (rng.random() < 0.5) + [nav] * (rng.random() < 0.85) + parts
    after = [x() for x in (side, side, advert, form, notice) if rng.random() < 0.3] + [comments] * (rng.random() < 0.4) + [footer] * (rng.random() < 0.85)
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>{''.join(before)}{shell.format(inner)}{''.join(after)}</body></html>", content


def train(pages: list[str], made: int = MADE_PAGES, seed: int = 0) -> BiLstm:
    """Fit on sampled pages with weak labels and on made pages with their own."""
    rng = np.random.default_rng(seed)
    known: list[tuple[list[Leaf], np.ndarray]] = []
    sentences: list[str] = []
    for page in pages:
        items = leaves(page)
        sentences += [x.text[:2000] for x in items if len(x.text) > 20][:20]
        labels = weak_labels(items)
        if labels is not None:
            known.append((items, labels))
    sentences = sentences or ["the quick brown fox jumps over the lazy dog near a quiet river, and nobody sees it."]
    for _ in range(made):
        page, content = made_page(rng, sentences)
        items, left, labels = leaves(page), list(content), []
        for x in items:
            labels.append(bool(left) and x.text == left[0] and not weak_bad(x))
            if labels[-1]:
                left.pop(0)
        if not left:
            known.append((items, np.array(labels, np.float32)))
    network = BiLstm(seed)
    network.fit(list(zip(page_vectors([x for x, _ in known]), [y for _, y in known], strict=True)), seed=seed)
    return network


def weak_bad(leaf: Leaf) -> bool:
    return any(x in NOT_ELEMENTS or x.partition(".")[2] in NOT_CONTENT for x in leaf.path)


def extract(network: BiLstm, pages: list[str]) -> list[str]:
    items = [leaves(p) for p in pages]
    shares = network.label(page_vectors(items))
    return ["\n\n".join(x.text for x, p in zip(some, share, strict=True) if p >= 0.5) for some, share in zip(items, shares, strict=True)]


def sample(pages: DataFrame, most: int = SAMPLE_PAGES) -> list[str]:
    """At most ``most`` pages of up to SAMPLE_BYTES, by a hash of page_id and html; a null or repeated page_id is no reason to leave one out."""
    some = pages.select(F.concat_ws(":", F.col("page_id").cast("string"), F.xxhash64("html").cast("string")).alias("id"), "html").where(F.col("html").isNotNull() & (F.octet_length("html") <= SAMPLE_BYTES))
    return [r.html for r in common.by_hash(some, F.col("id"), pages.count(), most).collect()]


def main_text(pages: DataFrame, network: BiLstm | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html; a null html is empty, its text too).

    Pages of any length are read whole; repeated rows give a row each, an empty table none. Other columns are not read,
    whatever their names. Without a ``network`` one is trained when this is called.
    """
    network = network or train(sample(pages))
    shared = pages.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = common.string_buffers(batch.column("html"))
            for a, b in common.row_chunks(offsets):
                part = batch.slice(a, b - a)
                texts = extract(shared.value, [x or "" for x in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_or_empty("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
