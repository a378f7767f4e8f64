"""Main-text extraction by a recurrent block labeller.

A page becomes a sequence of blocks (runs of text between block-level tags), each with two vectors: the mean of
learned vectors of the tags, class and id words on its path, and the mean of learned vectors of its hashed words; a
few numbers are added (length, share of link text, marks). A bidirectional LSTM in numpy reads the whole
sequence, so that every block is labelled in the context of the document. The weights lie beside this module;
html_training.py makes them from pages that it invents.
"""

from __future__ import annotations

import html
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PATH_BUCKETS, WORD_BUCKETS = 512, 512
PATH_DIM, WORD_DIM, NUMBERS = 20, 8, 8
HIDDEN = 20
WEIGHTS = Path(__file__).with_name("html_weights.npz")

#: HTML elements that never hold page text, that hold none and need no end, and that stay inside a line.
SILENT = {"script", "style", "head", "template", "noscript", "svg", "iframe", "object", "canvas", "math", "select", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
#: Of SILENT, those whose content is no markup (or is never shown), so that a missing end tag hides the rest of the page.
RAW = {"script", "style", "template", "noscript", "iframe", "textarea"}
#: What may stand in a head, in a select, and HTML inside a drawing; and what ends a drawing, as browsers have it.
HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "noframes", "script", "style", "template", "noscript"}
SELECT = {"option", "optgroup", "hr", "script", "template"}
HTML_INSIDE = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
BREAKOUT = {
    "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup",
    "table", "tt", "u", "ul", "var",
    # Browsers keep these in the drawing, but in a page they begin a part of it.
    "article", "aside", "footer", "header", "main", "nav", "section",
}
#: An element that a start tag of the key ends, if it is the innermost of its kind.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z!?])[^<>]*\Z", re.S)
_named = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_name = re.compile(r"[a-z]+")
_blank = re.compile(r"\s+")
_mark = re.compile(r"[.!?,;:]")


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def _after(page: str, tag: str, at: int) -> int | None:
    """The place behind the next end tag of tag, if there is one."""
    over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return over.end() if over else None


def silent_end(page: str, tag: str, at: int) -> int:
    """Where a SILENT element ends whose start tag ends at `at`; without an end tag, where browsers end it."""
    end = len(page)
    if tag in RAW:
        return _after(page, tag, at) or end
    if tag in ("object", "canvas"):
        # Left open, their content is the page's.
        return _after(page, tag, at) or at
    inside: list[str] = []
    broken = None
    while found := _token.search(page, at):
        if tag == "head" and page[at : found.start()].strip():
            return at
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name == tag and not inside:
                return at
            if name in inside:
                del inside[len(inside) - 1 - inside[::-1].index(name) :]
            elif name in ("body", "html") or (tag == "select" and name not in SELECT):
                return found.start()
            continue
        if name in RAW or (tag == "head" and name in ("title", "noframes")):
            if tag == "select" and name not in SELECT:
                return found.start()
            if not found[3].endswith("/"):
                at = _after(page, name, at) or end
        elif (tag == "head" and name not in HEAD) or (tag == "select" and name not in SELECT):
            return found.start()
        elif tag in ("svg", "math") and not found[3].endswith("/"):
            if name in BREAKOUT and not inside:
                return found.start()
            if name in BREAKOUT and broken is None:
                broken = found.start()  # where the drawing ends if its inner element is left open too
            if name in HTML_INSIDE or name == tag:
                inside.append(name)
    if tag == "head":
        return at
    return end if broken is None else broken


class Block:
    __slots__ = ("text", "path", "linked", "tag")

    def __init__(self, text: str, path: tuple[int, ...], linked: int, tag: str):
        self.text, self.path, self.linked, self.tag = text, path, linked, tag


def blocks(page: str) -> list[Block]:
    """Blocks with any text, in page order: white space made single blanks, character references decoded.

    Comments, and all inside elements that hold no page text, are left out. Missing end tags are supplied as
    browsers do; what is left open at the end is closed there, and a tag cut off by the page's end is dropped.
    """
    out: list[Block] = []
    #: (tag, whether inline, path buckets down to here)
    stack: list[tuple[str, bool, tuple[int, ...]]] = [("", False, ())]
    pieces: list[str] = []
    linked = links = 0
    owner = stack[0]

    def close() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _blank.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append(Block(text, owner[2], min(linked, len(text)), owner[0]))
        pieces, linked = [], 0

    def say(text: str) -> None:
        nonlocal owner, linked
        if not text:
            return
        if not pieces:
            if not text.strip():
                return
            owner = next(s for s in reversed(stack) if not s[1])
        pieces.append(text)
        if links:
            linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        found = _token.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                if any(not s[1] for s in stack[depth:]):
                    close()
                links -= sum(s[0] == "a" for s in stack[depth:])
                del stack[depth:]
            elif tag not in INLINE:
                close()
            continue
        if tag in SILENT and not found[3].endswith("/"):
            close() if tag not in ("script", "style", "template", "noscript") else None
            at = silent_end(page, tag, at)
            continue
        if tag == "br":
            say(" ") if pieces else None
            continue
        inline = tag in INLINE
        if not inline:
            close()
            if ends := ENDS.get(tag):
                # Looked for up to the nearest element that may hold its like: a table, a list or a division.
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        links -= sum(s[0] == "a" for s in stack[i:])
                        del stack[i:]
                        break
                    if not stack[i][1] and stack[i][0] in ("table", "ul", "ol", "dl", "div", "section", "article", "body"):
                        break
            elif stack[-1][0] == "p" or (stack[-1][1] and any(s[0] == "p" for s in stack)):
                # A block element ends an open paragraph.
                i = max(i for i, s in enumerate(stack) if s[0] == "p")
                if all(s[1] for s in stack[i + 1 :]):
                    links -= sum(s[0] == "a" for s in stack[i:])
                    del stack[i:]
        if tag in VOID or found[3].endswith("/"):
            continue
        path = stack[-1][2]
        if not inline:
            words = [tag]
            if "=" in found[3]:
                words += [w for m in _named.findall(found[3]) for w in _name.findall("".join(m).lower())]
            path += tuple(_bucket(w, PATH_BUCKETS) for w in words)
        stack.append((tag, inline, path))
        links += tag == "a"
    close()
    return out


def features(page: list[Block]) -> tuple[list[tuple[int, ...]], list[list[int]], np.ndarray]:
    """(path buckets, word buckets, numbers) of every block; all words of a block count."""
    paths = [b.path or (0,) for b in page]
    words = [[_bucket(w, WORD_BUCKETS) for w in _name.findall(b.text.lower())] or [0] for b in page]
    n = len(page)
    numbers = np.zeros((n, NUMBERS), np.float32)
    for i, b in enumerate(page):
        size = len(b.text)
        numbers[i] = (
            min(np.log1p(size) / 8, 2), b.linked / size, min(len(_mark.findall(b.text)) * 20 / size, 2), b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            b.tag == "p", b.tag == "li", i / n, min(size / 400, 1),
        )
    return paths, words, numbers


def _means(bags: list, table: np.ndarray) -> np.ndarray:
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    flat = np.fromiter((x for bag in bags for x in bag), np.int64, int(sizes.sum()))
    return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, pages, HIDDEN) for inputs (time, pages, dim); where live is 0 the state is carried on."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
    given = x @ w + b
    for t in range(steps):
        z = given[t] + h @ u
        i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = live[t][:, None]
        c2 = f * c + i * g
        h2 = o * np.tanh(c2)
        tape.append((h, c, i, f, o, g, c2, m))
        h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out, tape


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def load(cls, path: str | Path = WEIGHTS) -> Labeller:
        with np.load(path) as held:
            return cls({k: held[k].astype(np.float32) for k in held.files})

    def inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Padded (time, pages, dim) inputs and the mask of true blocks."""
        sizes = [len(p[0]) for p in pages]
        x = np.zeros((max(sizes), len(pages), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
        live = np.zeros((max(sizes), len(pages)), np.float32)
        flat = np.concatenate([_means([b for p in pages for b in p[0]], self.w["path"]), _means([b for p in pages for b in p[1]], self.w["word"]), np.concatenate([p[2] for p in pages])], axis=1)
        at = 0
        for k, n in enumerate(sizes):
            x[:n, k], live[:n, k] = flat[at : at + n], 1
            at += n
        return x, live, sizes

    def scores(self, pages: list[tuple]) -> list[np.ndarray]:
        """For every page's features, each block's probability of being main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p[0])), key=lambda k: len(pages[k][0]))
        low = 0
        while low < len(order):
            # So many pages at a time that the padded input stays small.
            high = low + 1
            while high < len(order) and high - low < 256 and len(pages[order[high]][0]) * (high - low) < 60_000:
                high += 1
            group = order[low:high]
            x, live, sizes = self.inputs([pages[k] for k in group])
            forth, _ = run_lstm(x, live, self.w["w1"], self.w["u1"], self.w["b1"])
            back, _ = run_lstm(x[::-1], live[::-1], self.w["w2"], self.w["u2"], self.w["b2"])
            p = sigmoid(np.concatenate([forth, back[::-1]], axis=2) @ self.w["v"] + self.w["c"])[:, :, 0]
            for j, k in enumerate(group):
                out[k] = p[: sizes[j], j]
            low = high
        return out

    def extract(self, pages: list[str | None]) -> list[str]:
        """The main text of every page: its main blocks, joined by a line break."""
        found = [blocks(p or "") for p in pages]
        scores = self.scores([features(f) for f in found])
        return ["\n".join(b.text for b, s in zip(f, own) if s >= 0.5) for f, own in zip(found, scores)]


_loaded: dict[str, Labeller] = {}


def labeller(path: str = str(WEIGHTS)) -> Labeller:
    if path not in _loaded:
        _loaded[path] = Labeller.load(path)
    return _loaded[path]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    The whole page is read; a null or empty page, and one without main text, gives an empty text. Repeated rows
    give a row each; other columns are not read. One narrow pass, in runs of pages of a few megabytes.
    """

    def run(batches):
        own = labeller()
        for batch in batches:
            low, size, texts = 0, 0, []
            values = batch.column(2)
            for at in range(batch.num_rows):
                texts.append(values[at].as_py())
                size += len(texts[-1] or "")
                if size >= 1 << 21 or at == batch.num_rows - 1:
                    found = own.extract(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), batch.column(1).slice(low, len(texts)), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])
                    low, size, texts = at + 1, 0, []

    kind, link = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kind}, url {link}, text string, n_chars bigint")
