"""Trains the block labeller on invented pages of many layouts, whose main blocks are known.

`python -m factweave.llm.html_training` writes html_weights.npz. Everything is seeded.
"""

from __future__ import annotations

import random

import numpy as np

from .html_extract import HIDDEN, NUMBERS, PATH_BUCKETS, PATH_DIM, WEIGHTS, WORD_BUCKETS, WORD_DIM, Labeller, blocks, features, run_lstm, sigmoid

_SYLLABLES = "an ba ce di en fo ga he in jo ka le mo ne or pa qu re sa ti un ve wi xo ya zu ou th er st ción que ung sch ß é ä ñ".split()
#: Names that pages give to their parts; each row is one kind of part.
_MENU = ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "main-menu", "site-nav", "tabs", "toc"]
_HEAD = ["header", "site-header", "masthead", "banner", "topbar", "branding", "page-header", "logo"]
_FOOT = ["footer", "site-footer", "copyright", "colophon", "bottom", "legal", "foot", "footer-links"]
_SIDE = ["sidebar", "aside", "side", "widget", "related", "recommended", "popular", "trending", "rail", "more-stories", "tags", "author-box", "social", "share", "sharing"]
_NOTE = ["cookie", "cookie-banner", "notice", "consent", "alert", "popup", "modal", "gdpr", "paywall", "newsletter", "subscribe", "disclaimer", "notification"]
_AD = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsbox", "sponsor", "ad-slot"]
_COMMENT = ["comments", "comment", "comment-list", "discussion", "replies", "responses", "disqus", "reader-comments", "user-comments", "comment-body"]
_MAIN = ["content", "main", "article", "post", "entry", "entry-content", "post-body", "article-body", "story", "text", "body-text", "main-content", "page-content", "post-content", "articleBody"]
_PLAIN = ["container", "wrapper", "row", "col", "inner", "block", "box", "group", "section", "page", "site", "layout", "grid", ""]


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        own = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(w + self.r.choice(("", "", "", "", "", ",", ".")) for w in own).capitalize() + self.r.choice((".", ".", ".", "", "!"))

    def tag(self, tag: str, inner: str, name: str = "") -> str:
        r = self.r
        if name:
            name = r.choice(("", "", "", r.choice(_PLAIN) + " ")) + name
        attribute = f' {r.choice(("class", "class", "id"))}="{name.strip()}"' if name.strip() else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.r
        each = [f'<a href="/{self.word()}">{self.words(1, r.choice((1, 2, 6))).rstrip(".") if r.random() < 0.7 else self.word()}</a>' for _ in range(r.randint(low, high))]
        kind = r.random()
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>"
        return r.choice((" ", " | ", " &middot; ")).join(each) if kind < 0.9 else "".join(f"<div>{a}</div>" for a in each)

    def prose(self, low: int = 4, high: int = 70) -> str:
        r = self.r
        text = self.words(low, high)
        if r.random() < 0.25:
            parts = text.split(" ")
            k = r.randrange(len(parts))
            parts[k] = r.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<strong>{}</strong>", "<span>{}</span>")).format(parts[k])
            text = " ".join(parts)
        return text

    def shell(self, inner: str, names: list[str], tags: tuple[str, ...], named: float = 0.85) -> str:
        r = self.r
        name = r.choice(names)
        out = self.tag(r.choice(tags), inner, name if r.random() < named else "")
        return self.tag("div", out, r.choice((r.choice(_PLAIN), name))) if r.random() < 0.2 else out

    def boilerplate(self) -> str:
        r = self.r
        kind = r.randrange(9)
        if kind == 0:
            return self.tag("nav", self.links(2, 9), r.choice(("", r.choice(_MENU))))
        if kind == 1:
            return self.shell(self.links(2, 9), _MENU, ("div", "nav", "ul", "section"), 1.0)
        if kind == 2:
            inner = r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", f'<a href="/">{self.words(1, 3)}</a>', f"<div>{self.words(1, 6)}</div>")) + r.choice(("", self.links(2, 5)))
            return r.choice((self.tag("header", inner), self.shell(inner, _HEAD, ("div", "header"), 1.0)))
        if kind == 3:
            inner = r.choice((self.words(3, 25), f"<p>&copy; 2020 {self.words(2, 20)}</p>", self.links(2, 6), f"&copy; {self.word()}.example.com &middot; {self.words(3, 15)}"))
            return r.choice((self.tag("footer", inner), self.shell(inner, _FOOT, ("div", "footer", "section"), 1.0)))
        if kind == 4:
            inner = "".join(r.choice((f"<h3>{self.words(1, 4)}</h3>", self.links(2, 6), f"<p>{self.prose(3, 30)}</p>", f"<div>{self.prose(3, 20)}</div>")) for _ in range(r.randint(1, 4)))
            return r.choice((self.tag("aside", inner), self.shell(inner, _SIDE, ("div", "aside", "section", "ul"), 1.0)))
        if kind == 5:
            inner = r.choice((self.prose(3, 40), f"<p>{self.prose(3, 40)}</p>", f"<p>{self.prose(3, 40)}</p><button>{self.words(1, 2)}</button>", f"<h3>{self.words(1, 4)}</h3><p>{self.prose(3, 30)}</p>"))
            return self.shell(inner, _NOTE, ("div", "section", "aside"), 1.0)
        if kind == 6:
            inner = r.choice((self.prose(2, 40), f"<p>{self.prose(2, 40)}</p>", f'<a href="/ad">{self.words(2, 20)}</a>', f"<h4>{self.words(2, 6)}</h4><p>{self.prose(2, 30)}</p>"))
            return self.shell(inner, _AD, ("div", "aside", "section", "ins", "p"), 1.0)
        if kind == 7:
            fields = "".join(f"<label>{self.words(1, 3)}</label><input>" for _ in range(r.randint(1, 3))) + f"<p>{self.words(2, 10)}</p>" * (r.random() < 0.4) + f"<button>{self.words(1, 2)}</button>"
            return self.tag("form", fields, r.choice(("", "search", "login", "signup", "contact-form")))
        each = "".join(r.choice((f'<div class="comment"><b>{self.word()}</b><p>{self.prose(3, 50)}</p></div>', f"<li><cite>{self.word()}</cite> {self.prose(3, 40)}</li>", f"<p>{self.prose(3, 40)}</p>", f'<article class="comment"><h4>{self.word()}</h4><p>{self.prose(3, 40)}</p></article>')) for _ in range(r.randint(1, 6)))
        return self.shell(r.choice(("", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 3)}</h3>")) + each, _COMMENT, ("div", "section", "ol", "ul", "aside"), 1.0)

    def main_part(self) -> str:
        r = self.r
        kind = r.random()
        mark = lambda t: "\x02" + t  # noqa: E731  what follows this sign is main text
        if kind < 0.68:
            text = mark(self.prose(2, r.choice((12, 70, 160))))
            return r.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"))
        if kind < 0.8:
            return f"<h{(n := r.choice((2, 2, 3, 4)))}>{mark(self.words(1, 9))}</h{n}>"
        if kind < 0.9:
            return r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f"<li>{mark(self.prose(2, 25))}</li>" for _ in range(r.randint(2, 6))))
        if kind < 0.95:
            return f"<blockquote><p>{mark(self.prose(4, 40))}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{mark(self.prose(4, 40))}</blockquote>"
        if kind < 0.98:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{mark(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<pre>{mark(self.prose(4, 30))}</pre>" if r.random() < 0.5 else f"<figure><figcaption>{mark(self.words(3, 12))}</figcaption></figure>"

    def page(self) -> str:
        r = self.r
        title = f"<h1>\x02{self.words(2, 12)}</h1>"
        parts = [self.main_part() for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14, 25)))]
        inner = "" if r.random() < 0.1 else title
        for p in parts:
            if r.random() < 0.05:
                inner += self.boilerplate_inside()
            inner += p
        style = r.random()
        if style < 0.5:
            main = self.tag("article", inner, r.choice(("", "", r.choice(_MAIN))))
        elif style < 0.7:
            main = self.tag("main", inner, r.choice(("", "", r.choice(_MAIN))))
        else:
            main = self.tag(r.choice(("div", "section")), inner, r.choice(_MAIN))
        if r.random() < 0.3:
            main = self.tag(r.choice(("main", "div", "section")), main + "".join(self.boilerplate() for _ in range(r.choice((0, 0, 1, 2)))), r.choice((*_PLAIN, *_MAIN)))
        if r.random() < 0.05:
            main = ""
        before = "".join(self.boilerplate() for _ in range(r.choice((0, 1, 2, 2, 3, 4))))
        after = "".join(self.boilerplate() for _ in range(r.choice((0, 1, 1, 2, 3, 4))))
        body = before + main + after
        if r.random() < 0.3:
            body = self.tag("div", body, r.choice(_PLAIN))
        out = f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}'
        return out if r.random() < 0.2 else out + "</body></html>"

    def boilerplate_inside(self) -> str:
        r = self.r
        names = r.choice((_AD, _NOTE, ["share", "social", "related", "share-buttons", "tags", "byline-links"]))
        inner = r.choice((self.links(1, 4), f"<p>{self.prose(2, 20)}</p>", self.prose(2, 20)))
        return self.tag(r.choice(("div", "aside", "div", "section")), inner, r.choice(names)) if r.random() < 0.8 else self.tag("aside", inner)


def examples(count: int, seed: int) -> list[tuple[tuple, np.ndarray]]:
    """(features, labels) of invented pages."""
    made, out = Pages(seed), []
    while len(out) < count:
        found = blocks(made.page())
        label = np.array(["\x02" in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace("\x02", "")
        if found:
            out.append((features(found), label))
    return out


def _back(grad_out: np.ndarray, tape: list, x: np.ndarray, w: np.ndarray, u: np.ndarray):
    """Gradients of run_lstm: (of x, of w, of u, of b)."""
    steps, pages, _ = x.shape
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    dz = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, c2, m = tape[t]
        dh = dh + grad_out[t]
        dh2, dc2 = dh * m, dc * m
        tanh = np.tanh(c2)
        dc2 = dc2 + dh2 * o * (1 - tanh * tanh)
        dz[t] = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh2 * tanh * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
        du += h.T @ dz[t]
        dh = dh * (1 - m) + dz[t] @ u.T
        dc = dc * (1 - m) + dc2 * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def train(pages: int = 6000, epochs: int = 5, seed: int = 1, say=print) -> Labeller:
    rng = np.random.default_rng(seed)
    dim = PATH_DIM + WORD_DIM + NUMBERS

    def start(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    w = {"path": start(PATH_BUCKETS, PATH_DIM, scale=0.5), "word": start(WORD_BUCKETS, WORD_DIM, scale=0.1), "v": start(2 * HIDDEN, 1, scale=0.2), "c": np.zeros(1, np.float32)}
    for k in "12":
        w |= {f"w{k}": start(dim, 4 * HIDDEN, scale=0.3), f"u{k}": start(HIDDEN, 4 * HIDDEN, scale=0.2), f"b{k}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"b{k}"][HIDDEN : 2 * HIDDEN] = 1
    net = Labeller(w)
    data = examples(pages, seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    size = 32
    for epoch in range(epochs):
        data.sort(key=lambda d: len(d[1]))
        groups = [data[i : i + size] for i in range(0, len(data), size)]
        rng.shuffle(groups)
        wrong = total = 0
        for group in groups:
            own = [d[0] for d in group]
            x, live, sizes = net.inputs(own)
            y = np.zeros(live.shape, np.float32)
            for j, (_, label) in enumerate(group):
                y[: len(label), j] = label
            f, tape1 = run_lstm(x, live, w["w1"], w["u1"], w["b1"])
            b, tape2 = run_lstm(x[::-1], live[::-1], w["w2"], w["u2"], w["b2"])
            both = np.concatenate([f, b[::-1]], axis=2)
            p = sigmoid(both @ w["v"] + w["c"])[:, :, 0]
            wrong += int((((p >= 0.5) != y) * live).sum())
            total += int(live.sum())
            d = ((p - y) * live / live.sum())[:, :, None].astype(np.float32)
            grad = {"v": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "c": d.sum(axis=(0, 1))}
            dboth = d @ w["v"].T
            dx1, grad["w1"], grad["u1"], grad["b1"] = _back(dboth[:, :, :HIDDEN], tape1, x, w["w1"], w["u1"])
            dx2, grad["w2"], grad["u2"], grad["b2"] = _back(dboth[::-1, :, HIDDEN:], tape2, x[::-1], w["w2"], w["u2"])
            dx = dx1 + dx2[::-1]
            flat = np.concatenate([dx[:n, j] for j, n in enumerate(sizes)])
            for name, at, low, high in (("path", 0, 0, PATH_DIM), ("word", 1, PATH_DIM, PATH_DIM + WORD_DIM)):
                bags = [bag for o in own for bag in o[at]]
                count = np.fromiter(map(len, bags), np.int64, len(bags))
                grad[name] = np.zeros_like(w[name])
                np.add.at(grad[name], np.concatenate([np.asarray(bag) for bag in bags]), np.repeat(flat[:, low:high] / count[:, None], count, axis=0))
            step += 1
            rate = 0.01 * (1 - step / (epochs * len(groups) + 1))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 1 / (norm + 1e-8))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        say(f"epoch {epoch + 1}: {wrong / total:.4f} of blocks wrong")
    return net


def accuracy(net: Labeller, count: int = 500, seed: int = 99) -> float:
    """Share of right blocks on pages that training has not seen."""
    data = examples(count, seed)
    scores = net.scores([f for f, _ in data])
    return float(np.mean(np.concatenate([(s >= 0.5) == y for s, (_, y) in zip(scores, data)])))


if __name__ == "__main__":
    net = train()
    print(f"held out: {accuracy(net):.4f} right")
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in net.w.items()})
