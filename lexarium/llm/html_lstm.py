"""Main text of web pages through a recurrent block labeller.

A page is read into its leaf blocks, in page order: text between two
block-level tags, with the path of elements above it. Each block becomes a
vector of its hashed tag path, its hashed words and a few measures; a
bidirectional LSTM in numpy reads the whole sequence and labels every block as
main text or not, so each label rests on the whole document around it. The
network is trained here, on pages that a seeded generator lays out in many
ways with known labels.

Memory is linear in the page: blocks share the elements above them, hold
their path's counts in a byte each, and become floats a slice at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm.common import spread

PATH_DIMS, WORD_DIMS, MEASURES = 256, 32, 10
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noframes noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video".split()
)
#: Elements whose content is raw text that isn't shown as such. All others are read, and the network judges what stands in them.
SILENT = frozenset("script style textarea title iframe xmp noembed".split())
VOID = frozenset("hr".split())
#: Elements that end an open p; which open element each ends, and where the search for it stops.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")


class Node:
    """An open element (tag and names) and the one above it."""

    __slots__ = ("above", "depth", "element")

    def __init__(self, element: tuple[str, ...], above: Node | None):
        self.element, self.above, self.depth = element, above, above.depth + 1 if above else 1


class Block:
    """A leaf block: the innermost element around it, the counts of its hashed path, its text, and how much of it is links.

    alike and beside: the shares of the page's text in blocks of the same path, and in blocks within the same element.
    """

    __slots__ = ("alike", "beside", "counts", "links", "node", "text")

    def __init__(self, node: Node | None, counts: bytes, text: str, links: float):
        self.node, self.counts, self.text, self.links = node, counts, text, links
        self.alike = self.beside = 0.0

    @property
    def path(self) -> tuple:
        """The elements from the outermost to the innermost."""
        out, node = [], self.node
        while node:
            out.append(node.element)
            node = node.above
        return tuple(reversed(out))


@lru_cache(65536)
def _slots(element: tuple[str, ...]) -> tuple[int, ...]:
    """The places of an element's tag and names in the path's vector."""
    return tuple(crc32(f"{'tag' if k == 0 else 'name'}:{word}".encode()) % PATH_DIMS for k, word in enumerate(element))


class _Path:
    """The open elements, how many there are of each name, and the sum of their vectors."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.open: dict[str, int] = {}
        self.counts, self.capped = [0] * PATH_DIMS, bytearray(PATH_DIMS)

    def push(self, element: tuple[str, ...]) -> None:
        self.nodes.append(Node(element, self.nodes[-1] if self.nodes else None))
        self.open[element[0]] = self.open.get(element[0], 0) + 1
        self._add(element, 1)

    def _add(self, element: tuple[str, ...], n: int) -> None:
        for k in _slots(element):
            self.counts[k] += n
            self.capped[k] = min(2, self.counts[k])

    def close(self, names: tuple, stops: tuple) -> None:
        """End the innermost element of one of the names, unless one of stops stands before it."""
        if not any(self.open.get(n) for n in names):
            return
        for k in range(len(self.nodes) - 1, -1, -1):
            name = self.nodes[k].element[0]
            if name in stops:
                return
            if name in names:
                for node in self.nodes[k:]:
                    self.open[node.element[0]] -= 1
                    self._add(node.element, -1)
                del self.nodes[k:]
                return

    def as_bytes(self) -> bytes:
        return bytes(self.capped)


@lru_cache(65536)
def _element(name: str, attrs: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    if "=" not in attrs:
        return (name,)
    words = {w for _, *values in _NAMED.findall(attrs) for value in values for w in _PART.findall(html.unescape(value).lower())}
    return (name, *sorted(words))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order, without blank ones."""
    page = page or ""
    found: list[Block] = []
    path = _Path()
    texts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                found.append(Block(path.nodes[-1] if path.nodes else None, path.as_bytes(), text, min(1.0, linked / len(text))))
            texts.clear()
        linked = 0

    while m := _TAG.search(page, at):
        if m.start() > at:
            texts.append(page[at : m.start()])
            linked += in_link * (m.start() - at)
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end = name.lower(), bool(m["end"] or m["end2"])
        if name in BLOCKS:
            flush()
            in_link = False
            if end:
                path.close((name,), ())
                continue
            if name != "p" or path.nodes:
                path.close(("p",), ("td", "th", "li", "div", "section", "article", "body", "blockquote", "figure", "aside", "main", "form", "fieldset", "button", "label") if name != "label" else ("p",))
            if name in ENDS:
                path.close(*ENDS[name])
            if name not in VOID:
                path.push(_element(name, m["attrs"] or m["attrs2"] or ""))
        elif name in SILENT:
            if not end and not (m["attrs"] or "").rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = over.end() if over else len(page)
        elif name == "a":
            in_link = not end
        elif name == "br":
            texts.append(" ")
    texts.append(page[at:])
    flush()
    _share(found)
    return found


def _share(page: list[Block]) -> None:
    """Fill in what depends on the other blocks of the page."""
    alike: dict[bytes, int] = {}
    beside: dict[int, int] = {}
    around = [id(b.node.above if b.node else None) for b in page]
    for block, above in zip(page, around):
        alike[block.counts] = alike.get(block.counts, 0) + len(block.text)
        beside[above] = beside.get(above, 0) + len(block.text)
    total = sum(len(b.text) for b in page)
    for block, above in zip(page, around):
        block.alike, block.beside = alike[block.counts] / total, beside[above] / total


@lru_cache(4096)
def _leaf(name: str) -> int:
    return crc32(f"leaf:{name}".encode()) % PATH_DIMS


def vectors(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """A row of features for each block from first to last."""
    part = page[first:last]
    out = np.zeros((len(part), DIMS), np.float32)
    if part:
        out[:, :PATH_DIMS] = np.frombuffer(b"".join(b.counts for b in part), np.uint8).reshape(-1, PATH_DIMS)
    for k, block in enumerate(part):
        row, words = out[k], block.text.lower().split()
        leaf = _leaf(block.node.element[0] if block.node else "")
        row[leaf] = min(2.0, row[leaf] + 1.0)
        places = np.bincount([crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIMS for w in words], minlength=WORD_DIMS)
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = 0.3 * places / np.sqrt(places @ places)
        n, w = len(block.text), len(words)
        depth = min(32, block.node.depth if block.node else 0)
        row[PATH_DIMS + WORD_DIMS :] = (np.log1p(n) / 5, np.log1p(w) / 4, block.links, block.text[-1] in ".!?\"'", block.text.count(",") / w, depth / 8, (first + k) / len(page), block.alike, block.beside, 1.0)
    return out


class BiLstm:
    """Weights of both directions and of the softmax over what they carry."""

    def __init__(self, seed: int = 3, dims: int = DIMS, hidden: int = HIDDEN):
        random = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = random.normal(0, 1 / np.sqrt(dims), (dims, 4 * hidden)).astype(np.float32)
            self.p[f"h{way}"] = random.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"c{way}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"c{way}"][hidden : 2 * hidden] = 1.0  # remember at first
        self.p["w"] = random.normal(0, 0.1, (2 * hidden, 2)).astype(np.float32)
        self.p["o"] = np.zeros(2, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool, state: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """States (time, page, hidden) of one direction, a tape for the gradients, and the last state; padding leaves a state as it is."""
        steps, n, _ = x.shape
        h, c = state or (np.zeros((n, self.hidden), np.float32),) * 2
        inputs = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
        out, tape = np.zeros((steps, n, self.hidden), np.float32), []
        H = self.hidden
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.p[f"h{way}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * H], -30, 30)))
            g = np.tanh(z[:, 3 * H :])
            i, f, o = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            m = mask[t][:, None]
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out, tape, (h, c)

    def logits(self, pages: list[list[Block]], most: int = 1 << 13) -> np.ndarray:
        """(time, page, 2) of pages that are read side by side, in slices of about ``most`` blocks whose states go on."""
        steps, H = max(map(len, pages)), self.hidden
        width = max(1, most // len(pages))
        out = np.zeros((steps, len(pages), 2), np.float32)
        slices = [(a, min(a + width, steps)) for a in range(0, steps, width)]
        for k, way in enumerate("fb"):
            state = None
            for a, b in slices if way == "f" else reversed(slices):
                if len(slices) > 1 or way == "f":
                    x, mask = padded([vectors(p, a, b) for p in pages], b - a)
                states, _, state = self._run(x, mask, way, False, state)
                out[a:b] += states @ self.p["w"][k * H : (k + 1) * H]
        return out + self.p["o"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and its gradients by back-propagation through time."""
        H, runs = self.hidden, {way: self._run(x, mask, way, True) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        z = both @ self.p["w"] + self.p["o"]
        z -= z.max(axis=2, keepdims=True)
        prob = np.exp(z) / np.exp(z).sum(axis=2, keepdims=True)
        total = mask.sum()
        loss = float(-(np.log(np.take_along_axis(prob, y[:, :, None], 2)[:, :, 0] + 1e-9) * mask).sum() / total)
        d = prob.copy()
        np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
        d *= (mask / total)[:, :, None]
        grads = {"w": np.einsum("tnh,tnk->hk", both, d), "o": d.sum(axis=(0, 1))}
        d_both = d @ self.p["w"].T
        for k, way in enumerate("fb"):
            dh_next = dc_next = np.zeros((x.shape[1], H), np.float32)
            dz = np.zeros((x.shape[0], x.shape[1], 4 * H), np.float32)
            gh = np.zeros_like(self.p[f"h{way}"])
            for t, h, c, i, f, o, g, tc, m in reversed(runs[way][1]):
                dh = d_both[t][:, k * H : (k + 1) * H] + dh_next
                dn = dh * m
                dc = dc_next * m + dn * o * (1 - tc * tc)
                row = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dn * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                dz[t] = row
                gh += h.T @ row
                dh_next = row @ self.p[f"h{way}"].T + dh * (1 - m)
                dc_next = dc * f + dc_next * (1 - m)
            grads[f"x{way}"] = np.einsum("tnd,tnk->dk", x, dz, optimize=True)
            grads[f"h{way}"], grads[f"c{way}"] = gh, dz.sum(axis=(0, 1))
        return loss, grads


def padded(pages: list[np.ndarray], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, dims) and the mask of what isn't padding."""
    steps = steps or max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
    return x, mask


#: What the generator writes around and into main text: containers of main text, wrappers of any part, and containers of all else.
SHOWN = ("article", "main", "section", 'div class="content"', 'div class="post-content"', 'div id="content"', 'div class="entry-content"', 'div class="article-body"', 'div class="story"', 'div id="main"', 'div class="post"', 'div class="text"', 'div role="main"', "div", 'div id="bodyContent"', 'article class="post hentry"', 'div class="page-content"', 'div class="body"', 'div itemprop="articleBody"', 'div class="markdown-body"', 'td class="content"', "td", "center")
WRAPS = ("div", "div", 'div id="page"', 'div class="wrapper"', 'div class="row"', 'div class="container"', 'div class="inner"', 'div class="layout"', 'div class="col-md-8"', 'div id="content"', 'div class="site"', 'div class="grid"', "section", "main", 'div class="main-column"', 'div id="wrap"', 'div class="site-content"')
NOISE = {
    "menu": ("nav", 'div class="menu"', 'ul class="nav"', 'div id="navigation"', 'div class="navbar"', 'div class="breadcrumbs"', 'div class="pagination"', 'nav class="toc"', 'div role="navigation"', 'div id="toc"', 'td class="menu"', 'div class="nav-links"', "ul", "td"),
    "header": ("header", 'div id="header"', 'div class="header"', 'div class="masthead"', 'div class="site-header"', 'div role="banner"', 'div class="topbar"', 'div class="logo"'),
    "footer": ("footer", 'div id="footer"', 'div class="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"', 'div class="legal"', 'table class="footer"', 'div class="bottom"'),
    "aside": ("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"', 'section class="related-posts"', 'div class="recommended"', 'aside class="sidebar"', 'div class="share"', 'div class="social"', 'div role="complementary"', 'div class="tags"', 'div class="col-md-4"', 'div id="secondary"', 'td class="sidebar"', 'div class="see-also"', 'ul class="related-links"'),
    "notice": ('div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="alert"', 'div class="popup"', 'div class="modal"', 'div class="consent"', 'div role="alert"', 'div class="newsletter"', 'div class="subscribe"', "dialog", 'div id="siteNotice"', "noscript", 'div class="gdpr"'),
    "advert": ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div class="banner"', 'aside class="ad"', 'div id="ad-top"', 'p class="ad"', 'section class="promo"', 'object class="ad"', 'div class="ad-slot"'),
    "form": ("form", 'form class="search"', 'form id="login"', 'form class="subscribe"', 'div class="search-form"', "fieldset", "select"),
    "comments": ('div class="comments"', 'section id="comments"', 'div id="comments"', 'section class="comments"', 'div class="discussion"', 'ol class="comment-list"', 'div class="responses"', 'div id="disqus"', 'section class="reader-comments"'),
}
#: Inline elements that stand open, closed or wrong within a text.
INLINE = ("b", "i", "em", "strong", "span", "code", "u", 'span class="x"', 'font color="red"', "small", "sup")


class PageMaker:
    """Random pages with the label of each leaf block; words are invented anew for each page.

    A page is a column or a table of parts, within wrappers of any depth;
    main text is made of paragraphs, of bare text between line breaks, or of
    div elements, with headings, lists, tables, quotes and code; other parts
    stand before, within and after it, in named containers or anonymous ones.
    """

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[int(self.r.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def count(self, low: int, high: int) -> int:
        return int(self.r.integers(low, high + 1))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.pick(self.vocabulary) for _ in range(self.count(low, high)))

    def sentence(self, low: int = 4, high: int = 40) -> str:
        text = self.words(low, high)
        end = self.pick((".", ".", ".", "!", "?", "", ":", "\u2026", ".)", self.odd * self.count(1, 3)))
        return text[:1].upper() + text[1:] + end

    def rich(self, low: int, high: int) -> str:
        """Sentences with links, inline elements and line breaks within, some of them never closed."""
        parts = [self.sentence(low, high) for _ in range(self.count(1, 3))]
        for k, part in enumerate(parts):
            if self.chance(0.15):
                tag = self.pick(INLINE)
                parts[k] = f"<{tag}>{part}" + (f"</{tag.split()[0]}>" if self.chance(0.7) else "")
            elif self.chance(0.12):
                parts[k] = part + " " + self.link()
            elif self.chance(0.06):
                parts[k] = part + " <math><mi>x</mi><mo>=</mo><mn>1</mn></math>"
        return self.pick((" ", " ", "  ", "<br>", "\n")).join(parts) + ("<br>" if self.chance(0.05) else "")

    def put(self, tag: str, text: str, label: int, closed: bool = True) -> None:
        self.out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if closed else ""))
        self.labels += [label] if text.strip() else []

    def bare(self, text: str, label: int) -> None:
        self.out.append(text)
        self.labels.append(label)

    def link(self) -> str:
        return f'<a href="/{self.pick(self.vocabulary)}">{self.words(1, 3)}</a>'

    def named(self, tags) -> str:
        """A container, in some cases with a name that tells nothing."""
        tag = self.pick(tags)
        if tag.startswith("div ") and self.chance(0.12):
            return f'div class="{self.pick(self.vocabulary).strip(",")}"'
        return tag

    def noise(self, kind: str) -> None:
        outer = self.named(NOISE[kind])
        name = outer.split()[0]
        if name == "td":
            outer, name = "div", "div"
        self.out.append(f"<{outer}>")
        if name == "select":
            for _ in range(self.count(2, 6)):
                self.put("option", self.words(1, 3), 0, self.chance(0.5))
        elif name in ("ul", "ol"):
            for _ in range(self.count(1, 8)):
                self.put("li", self.link() if kind in ("menu", "aside") else self.sentence(1, 25), 0)
        elif name == "p":
            self.bare(self.sentence(3, 20), 0)
        elif name == "table":
            self.out.append("<tr>")
            for _ in range(self.count(1, 4)):
                self.put("td", self.link() if self.chance(0.6) else self.words(1, 6), 0)
            self.out.append("</tr>")
        else:
            getattr(self, kind)()
        self.out.append(f"</{name}>")

    def menu(self) -> None:
        if self.chance(0.3):
            self.bare(self.pick((" ", " | ", " &gt; ")).join(self.link() for _ in range(self.count(2, 8))), 0)
        elif self.chance(0.15):
            for _ in range(self.count(2, 8)):
                self.put("div", self.link(), 0)
        else:
            if self.chance(0.2):
                self.put(self.pick(("h2", "h3", "div")), self.words(1, 2), 0)
            self.out.append("<ul>")
            for _ in range(self.count(1, 12)):
                self.put("li", self.link(), 0, self.chance(0.9))
            self.out.append("</ul>")

    def header(self) -> None:
        self.put(self.pick(("h1", "div", "p", "h2")), self.link() if self.chance(0.3) else self.words(1, 6), 0)
        if self.chance(0.5):
            self.put("p", self.sentence(2, 10), 0)
        if self.chance(0.15):
            self.out.append("<svg><text>")
            self.bare(self.words(1, 2), 0)
            self.out.append("</text></svg>")
        if self.chance(0.4):
            self.noise("menu")

    def form(self) -> None:
        for _ in range(self.count(1, 4)):
            self.put(self.pick(("label", "p", "legend", "button")), self.words(1, 8), 0)
        if self.chance(0.4):
            self.out.append('<input name="q"><select><option>')
            self.bare(self.words(1, 2), 0)
            self.out.append("</select><textarea>x</textarea>")

    def comments(self) -> None:
        self.put(self.pick(("h2", "h3")), self.words(1, 3), 0)
        for _ in range(self.count(1, 6)):
            inner = self.pick(('div class="comment"', 'article class="comment"', "li", "div", 'div class="reply"'))
            self.out.append(f"<{inner}>")
            if self.chance(0.4):
                self.put(self.pick(("div", "h4", 'div class="author"')), self.words(1, 3), 0)
            for _ in range(self.count(1, 2)):
                self.put("p", self.sentence(2, 40), 0)
            self.out.append(f"</{inner.split()[0]}>")

    def scattered(self) -> None:
        """Short texts and links, as in footers, side columns, notices and adverts."""
        if self.chance(0.4):
            self.bare(self.pick(("", "&copy; 2020 ", "", "")) + self.sentence(2, 20), 0)
            return
        for _ in range(self.count(1, 5)):
            tag = self.pick(("p", "p", "h3", "div", "li"))
            self.put(tag, self.link() if self.chance(0.35) else self.sentence(2, 25), 0)
        if self.chance(0.3):
            self.out.append("<ul>")
            for _ in range(self.count(1, 4)):
                self.put("li", self.link(), 0)
            self.out.append("</ul>")

    footer = aside = notice = advert = scattered

    def title(self) -> None:
        head = self.pick(("h1", "h1", "h1", 'h1 class="title"', 'h1 id="firstHeading"', "h2"))
        if self.chance(0.15):
            self.out.append(self.pick(("<header>", '<header class="entry-header">', '<div class="title">', "<hgroup>")))
            self.put(head, self.words(2, 12), 1)
            self.out.append(f"</{re.match('<(\\w+)', self.out[-2])[1]}>")
        else:
            self.put(head, self.words(2, 12), 1)

    def part(self, paragraph: str) -> None:
        """A piece of main text."""
        kind = self.r.random()
        if kind < 0.68:
            if paragraph == "bare":
                self.bare(self.rich(1, self.longest) + "<br><br>" + self.rich(1, self.longest), 1)
                self.out.append(self.pick(("<hr>", "<p></p>", "<div></div>")))
            else:
                self.put(paragraph, self.rich(1, self.longest), 1, paragraph != "p" or self.chance(0.85))
        elif kind < 0.78:
            self.put(self.pick(("h2", "h3", "h2", "h4")), self.words(1, 8), 1)
        elif kind < 0.84:
            outer = self.pick(("ul", "ol", "dl"))
            self.out.append(f"<{outer}>")
            for k in range(self.count(1, 6)):
                self.put(("dt", "dd")[k % 2] if outer == "dl" else "li", self.sentence(1, 20), 1, self.chance(0.8))
            self.out.append(f"</{outer}>")
        elif kind < 0.9:
            self.put(self.pick(("blockquote", "pre", "figcaption", "figure")), self.sentence(2, 40), 1)
        elif kind < 0.93:
            self.out.append(self.pick(("<table>", '<table class="infobox">', '<table class="data">')))
            for _ in range(self.count(1, 5)):
                self.out.append("<tr>")
                for tag in ("th", "td") if self.chance(0.5) else ("td",) * self.count(1, 4):
                    self.put(tag, self.words(1, 5), 1)
                self.out.append("</tr>")
            self.out.append("</table>")
        else:
            self.noise(self.pick(("advert", "advert", "aside", "form", "notice", "menu")))

    def shown(self) -> None:
        outer = self.named(SHOWN)
        table = outer.startswith("td")
        wraps = [self.named(WRAPS) for _ in range(int(self.pick((0, 0, 0, 1, 1, 2, 3))))]
        outside = self.chance(0.12)
        self.out += [f"<{w}>" for w in wraps]
        if outside:
            self.title()
        if table:
            self.out.append("<table><tr>")
            if self.chance(0.6):
                self.out.append('<td class="left">')
                self.menu()
                self.out.append("</td>")
        self.out.append(f"<{outer}>" + ("<div>" if self.chance(0.2) else ""))
        if not outside and self.chance(0.75):
            self.title()
        paragraph = self.pick(("p", "p", "p", "p", "p", "p", "div", "bare", 'p class="x"'))
        first = len(self.labels)
        for _ in range(int(self.pick((1, 1, 2, 3, 5, 8, 13, 20)))):
            self.part(paragraph)
        if not any(self.labels[first:]):
            self.put("p", self.rich(1, self.longest), 1)
        if self.chance(0.12):
            self.noise(self.pick(("comments", "aside")))
        self.out.append(f"</{outer.split()[0]}>" + ("</tr></table>" if table else ""))
        self.out += [f"</{w.split()[0]}>" for w in reversed(wraps)]

    def page(self) -> tuple[str, list[int]]:
        parts = [self.syllable() for _ in range(24)]
        self.vocabulary = ["".join(self.pick(parts) for _ in range(self.count(1, 4))) + self.pick(("", "", "", ",")) for _ in range(300)]
        self.longest = self.pick((3, 8, 20, 50, 50, 80))
        self.odd = self.pick("~^=+_;\u00a4\u00a7\u2013")
        style = self.pick(("", "<style>body{margin:0}</style>", "<script>var x=1</script>", '<style type="text/css">a{}</style><script src="x"></script>'))
        self.out: list[str] = [f"{self.pick(('<!DOCTYPE html>', '', '<!-- x -->'))}<html><head><title>x</title>{style}</head><body>"]
        self.labels: list[int] = []
        wrapped = self.chance(0.25)
        self.out.append(f"<{self.pick(WRAPS)}>" if wrapped else "")
        before = [k for k in ("notice", "header", "menu", "advert", "form", "aside") if self.chance(0.4)]
        after = [k for k in ("advert", "comments", "aside", "form", "footer", "notice", "menu") if self.chance(0.35)]
        blank = self.chance(0.06)  # a page without main text
        if blank and self.chance(0.5):
            before, after = [self.pick(("menu", "menu", "header", "form", "aside"))], []
        for kind in before:
            self.noise(kind)
        if not blank:
            self.shown()
        for kind in after:
            self.noise(kind)
        if self.chance(0.6) and not blank:
            self.noise("footer")
        if self.chance(0.1):
            self.noise(self.pick(list(NOISE)))
        self.out.append("</body></html>" if self.chance(0.9) else "")
        return "".join(self.out), self.labels

    def syllable(self) -> str:
        return "".join(self.pick("aeiou\u00e4\u00e9\u00ed\u00f3\u00fc" if k % 2 else "bcdfghlmnprstvw\u00f1\u00df") for k in range(self.count(1, 3)))


@lru_cache(2)
def trained(pages: int = 3600, epochs: int = 8, seed: int = 7) -> BiLstm:
    """A labeller, trained with Adam on generated pages; the same for the same arguments. Its weights are the mean of the last two epochs'."""
    made = []
    maker = PageMaker(seed)
    while len(made) < pages:
        page, labels = maker.page()
        found = blocks(page)
        if found and len(found) == len(labels):
            made.append((vectors(found), np.array(labels)))
    made.sort(key=lambda m: len(m[1]))
    batches = [made[k : k + 32] for k in range(0, len(made), 32)]
    model, random = BiLstm(), np.random.default_rng(seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    step, mean, held = 0, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        for at in random.permutation(len(batches)):
            x, mask = padded([m[0] for m in batches[at]])
            y = np.zeros(mask.shape, np.int64)
            for k, (_, labels) in enumerate(batches[at]):
                y[: len(labels), k] = labels
            _, grads = model.gradients(x, mask, y)
            step += 1
            rate = 0.01 * (1 - 0.85 * epoch / epochs)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m1, m2 = moments[k]
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                model.p[k] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
            if epoch >= epochs - 2:
                held += 1
                for k, v in model.p.items():
                    mean[k] += (v - mean[k]) / held
    if held:
        model.p = mean
    return model


def labelled(pages: list[list[Block]], model: BiLstm, most: int = 1 << 14) -> list[np.ndarray]:
    """Whether each block of each page is main text. Pages of like length go through the network together."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= most:
            end += 1
        own = order[at:end]
        z = model.logits([pages[k] for k in own])
        for j, k in enumerate(own):
            out[k] = z[: len(pages[k]), j, 1] > z[: len(pages[k]), j, 0]
        at = end
    return out


def main_texts(pages: list[str | None], model: BiLstm) -> list[str]:
    """The main text of each page: its blocks of main text, one on each line."""
    found = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, keep in zip(page, label) if keep) for page, label in zip(found, labelled(found, model))]


def extracted(pages: DataFrame, model: BiLstm | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html, ...).

    A null or empty page, or one without main text, has an empty text;
    repeated rows get equal texts; an empty table gives an empty result;
    further columns are ignored, whatever their names.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # a few thousand weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(part.column("html").to_pylist(), shared.value)
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return spread(slim).mapInArrow(run, "page_id long, url string, text string, n_chars long")
