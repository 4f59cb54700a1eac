"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks (``dom.blocks``). The field scores each block by
its ancestors' tags and names and by the shape of its text, and each pair of
neighbours by their labels; Viterbi decoding gives the best labels of a page as
a whole, and the blocks labelled main are joined.

The field is trained by gradient ascent on the log-likelihood (forward-backward)
over labelled pages of many layouts. These are written by ``labelled_pages``
from a seed: what is main is known as each block is written. The model has a
weight for each feature of those pages, a size that doesn't depend on the input.

Defined results: null or empty html gives an empty text; a page without main
blocks too; repeated rows get equal results; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.dom import Block, blocks

#: Labelled pages that are written and learned from.
PAGES, EPOCHS = 500, 8
#: Stands in a block that is main while pages are written; never in a feature.
MAIN = "⁣"
#: Names that parts of pages commonly carry.
NAMES = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs toc pagination topnav",
    "header": "header masthead banner top branding logo",
    "footer": "footer foot copyright colophon bottom legal",
    "aside": "sidebar aside related widget side rail recommended more trending",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense",
    "notice": "cookie notice consent gdpr alert banner popup modal newsletter",
    "form": "search login subscribe signup form contact",
    "comments": "comments comment replies discussion responses disqus",
    "share": "share social sharing buttons tools",
    "main": "content main article post entry body story text page",
}


def labelled_pages(n: int = PAGES, seed: int = 5) -> Iterator[str]:
    """Pages whose main blocks begin with MAIN."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrstdmé") for _ in range(r.randint(1, 9)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi)))

    def sentence(lo: int = 2, hi: int = 30) -> str:
        s = words(lo, hi)
        if r.random() < 0.12:  # tables of words, prices, headings in signs, lists of tags
            s = r.choice([" | ", " » ", " * ", "### ", " - ", "$$$ ", " 12 ", " © "]).join(s.split())
        return s[:1].upper() + s[1:] + r.choice(["...", ".", ".", ".", "!", "?", ",", ""])

    def named(kind: str, tag: str) -> str:
        names = " ".join(r.sample(NAMES[kind].split(), r.randint(1, 2)))
        return f'<{tag} {r.choice(["class", "class", "id"])}="{names}">'

    def opened(kind: str, own: str) -> tuple[str, str]:
        """By its own element or by a name."""
        if r.random() < 0.6:
            return (f"<{own}>" if r.random() < 0.6 else named(kind, own)), f"</{own}>"
        tag = r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        return named(kind, tag), f"</{tag}>"

    def linklist() -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, r.choice([1, 3, 8]))}</a></li>' for _ in range(r.randint(1, 9))) + "</ul>"

    def wrapped(kind: str, own: str, inner: str) -> str:
        a, b = opened(kind, own)
        return a + inner + b

    def paragraphs(mark: str, n: int) -> str:
        out = []
        for _ in range(n):
            t = mark + (sentence() if r.random() < 0.4 else " ".join(sentence(1, 20) for _ in range(r.randint(1, 6))))
            if r.random() < 0.15:
                t = t.replace(" ", f' <a href="/{word()}">', 1) + "</a>"
            out.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<blockquote>{}</blockquote>"]).format(t))
        return "".join(out)

    def main() -> str:
        body = []
        if r.random() < 0.8:
            h = f"<h1>{MAIN}{words(1, 14)}</h1>"
            body.append(f"<header>{h}</header>" if r.random() < 0.2 else h)
        for _ in range(r.randint(1, 4)):
            body.append(paragraphs(MAIN, r.randint(1, 6)))
            k = r.random()
            if k < 0.2:
                body.append(f"<h2>{MAIN}{words(1, 6)}</h2>")
            elif k < 0.35:
                body.append("<ul>" + "".join(f"<li>{MAIN}{sentence(1, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.42:
                body.append("<table><tr>" + "".join(f"<td>{MAIN}{words(1, 3)}</td>" for _ in range(r.randint(1, 5))) + "</tr></table>")
            elif k < 0.7:  # articles are interrupted, and go on
                kind = r.choice(["ad", "aside", "notice", "form"])
                body.append(wrapped(kind, "aside", r.choice([sentence(), f"<p>{sentence()}</p>", paragraphs("", 2)])) + paragraphs(MAIN, 1))
            elif k < 0.75:
                body.append(f"<pre>{MAIN}{words(3, 30)}</pre>")
        if r.random() < 0.2:
            body.append(named("share", "div") + linklist() + "</div>")
        return "".join(body)

    def comments() -> str:
        each = r.choice(["<article>{}</article>", "<div>{}</div>", "<li>{}</li>"])
        return named("comments", r.choice(["section", "div", "ol"])) + f"<h3>{words(1, 3)}</h3>" + "".join(each.format(paragraphs("", r.randint(1, 3))) for _ in range(r.randint(1, 4))) + r.choice(["</section>", "</div>"])

    for _ in range(n):
        before = [
            wrapped("header", "header", r.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{sentence()}</p>", f'<a href="/">{words(1, 3)}</a>', linklist()])),
            wrapped("nav", "nav", linklist()),
            wrapped("notice", "div", paragraphs("", r.randint(1, 2))) if r.random() < 0.7 else named("notice", "div") + sentence() + "<button>ok</button></div>",
            named("ad", "div") + r.choice([sentence(), f"<p>{sentence()}</p>", paragraphs("", 2)]) + "</div>",
            wrapped("form", "form", f"<label>{words(1, 3)}</label><input><button>{word()}</button>"),
        ]
        after = [
            wrapped("aside", "aside", f"<h3>{words(1, 4)}</h3>" + r.choice([linklist(), paragraphs("", r.randint(1, 3))])),
            wrapped("footer", "footer", r.choice([f"&copy; {word()}.example.com &middot; {sentence()}", f"<p>&copy; 2020 {words(1, 5)}</p>" + linklist(), paragraphs("", 1)])),
            comments(),
            named("ad", "div") + paragraphs("", 1) + "</div>",
        ]
        r.shuffle(before)
        kind = r.random()
        own = "<article>", "</article>"
        if kind > 0.5:
            own = r.choice([("<main>", "</main>"), ("<main><article>", "</article></main>"), (named("main", "div"), "</div>"), (named("main", "article"), "</article>"), ("", ""), ("<div>", "</div>")])
        inner = main()
        if own[0].startswith("<article") and r.random() < 0.1:
            inner += comments()
        yield "<html><head><title>x</title></head><body>" + "".join(b for b in before if r.random() < 0.5) + own[0] + inner + own[1] + "".join(a for a in after if r.random() < 0.5) + "</body></html>"


def pages_with_stand_ins(n: int, seed: int) -> Iterator[str]:
    """Labelled pages with elements that most readers see only in place of something else; these aren't main."""
    r = random.Random(seed)
    for page in labelled_pages(n, seed):
        said = "".join(r.choice("aeioulnrstd ") for _ in range(r.randint(10, 90)))
        page = page.replace("<body>", f"<body><noscript><{(t := r.choice(['p', 'div']))}>{said}.</{t}></noscript>", r.random() < 0.7)
        tag = r.choice(["video", "audio", "object", "iframe", "canvas", "noscript"])
        yield page.replace("</p>", f"</p><{tag}><p>{said}</p></{tag}>", r.random() < 0.7)


class Field:
    """weight: of a feature for the label main; step: label x next label; first: of a page's first label."""

    def __init__(self, weight: dict[str, float], step: np.ndarray, first: np.ndarray):
        self.weight, self.step, self.first = weight, step, first

    def labels(self, page: list[Block]) -> list[int]:
        """Viterbi decoding."""
        get, ((s00, s01), (s10, s11)) = self.weight.get, self.step.tolist()
        back: list[tuple[int, int]] = []
        a, b = self.first.tolist()
        for k, block in enumerate(page):
            score = sum([get(f, 0.0) for f in block.features])
            if k:
                from0, from1 = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 >= b + s11 else 1)
                a, b = max(a + s00, b + s10), max(a + s01, b + s11)
                back.append((from0, from1))
            b += score
        out = [int(b > a)] if page else []
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    def text(self, page: str) -> str:
        found = blocks(page, self.weight)
        return "\n".join(b.text for b, y in zip(found, self.labels(found), strict=True) if y)


def marginals(score: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks x labels scores: the labels' probabilities, and those of neighbouring labels summed over the page.

    Forward and backward values are scaled to a sum of 1 at each block.
    """
    e = np.exp(score - score.max(1, keepdims=True)).tolist()
    (s00, s01), (s10, s11) = np.exp(step - step.max()).tolist()
    a, b = np.exp(first - first.max()).tolist()
    forth, back = [], [(1.0, 1.0)]
    for k, (e0, e1) in enumerate(e):
        if k:
            a, b = a * s00 + b * s10, a * s01 + b * s11
        a, b = a * e0, b * e1
        total = a + b
        a, b = a / total, b / total
        forth.append((a, b))
    for e0, e1 in e[:0:-1]:
        a, b = back[-1][0] * e0, back[-1][1] * e1
        a, b = s00 * a + s01 * b, s10 * a + s11 * b
        total = a + b
        back.append((a / total, b / total))
    forth, back = np.array(forth), np.array(back[::-1])
    p = forth * back
    pairs = forth[:-1, :, None] * np.exp(step - step.max()) * (np.array(e)[1:] * back[1:])[:, None, :]
    return p / p.sum(1, keepdims=True), (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)


def train(pages: Iterator[str], epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """AdaGrad steps along the gradient of each page's log-likelihood."""
    seen = []
    names: dict[str, int] = {}
    for page in pages:
        truth = np.array([int(MAIN in b.text) for b in blocks(page)])
        if len(truth):
            # the mark isn't part of the text: its features are made anew without it
            clean = blocks(page.replace(MAIN, ""))
            size = np.array([len(b.features) for b in clean])
            seen.append((np.array([names.setdefault(f, len(names)) for b in clean for f in b.features]), size, np.cumsum(size) - size, truth))
    weight, step, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    squares = [np.full(x.shape, 1e-8) for x in (weight, step, first)]
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(seen)):
            features, size, begin, truth = seen[k]
            main = np.add.reduceat(weight[features], begin)
            p, both = marginals(np.stack((np.zeros_like(main), main), 1), step, first)
            slope = [np.bincount(features, np.repeat(truth - p[:, 1], size), len(weight)), -both, np.eye(2)[truth[0]] - p[0]]
            np.add.at(slope[1], (truth[:-1], truth[1:]), 1)
            for value, g, q in zip((weight, step, first), slope, squares, strict=True):
                g = g - ridge * value
                q += g * g
                value += rate * g / np.sqrt(q)
    return Field({n: float(weight[i]) for n, i in names.items()}, step, first)


@cache
def field() -> Field:
    """The field of the labelled pages, trained once in a session."""
    return train(chain(labelled_pages(), pages_with_stand_ins(PAGES // 20, 6)))


def main_text(pages: DataFrame, model: Field | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    model = model or field()
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [model.text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {dict(source.dtypes)['page_id']}, url {dict(source.dtypes)['url']}, text string, n_chars long")
