"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A block is a run of text between tags that break lines. Its features are its ancestors' tags, the words of their class, id and
role attributes, and marks of its text (links, length, final stop, copyright signs, place on the page). The field labels each
block as article or not, knowing how labels follow each other, and the best labelling is found by Viterbi. It is trained by
gradient ascent on labelled pages: labelled_pages() makes them from templates of articles with menus, headers, footers,
sidebars, notices, adverts, forms and comments about and inside them, in many mark-ups; more can be given.

Extraction is one pass over whole pages without a shuffle. Character references are decoded, white space inside a block is one
space, `<br>` counts as white space, and blocks are joined by a line feed. Scripts, styles, comments and the head give no
blocks; a tag that is cut off at the end of the page is no text.

Defined results: null, empty or text-free html gives an empty text; html without any tag is one block; repeated rows give equal
texts; null ids and URLs are carried; an empty table gives an empty result. Other columns are carried as they are.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, read_table

#: HTML's elements that break lines, that have no content, whose content is no text, and inline ones that matter.
BREAKING = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "title", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "audio", "video", "canvas", "xmp", "noembed", "noframes")
#: Of those, the ones whose content is raw up to their end tag, and those that may close themselves.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
FOREIGN = frozenset(("svg", "math"))
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Za-z][a-z]*")


class Block:
    __slots__ = ("linked", "parts", "path", "text")

    def __init__(self, path):
        self.path, self.parts, self.linked, self.text = path, [], 0, ""


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in order, with the (tag, attribute words) of their ancestors."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    now: Block | None = None
    html, at = html or "", 0

    def text(s: str) -> None:
        nonlocal now
        if not s:
            return
        if now is None:
            if s.isspace():
                return
            now = Block(tuple(stack))
        s = entities.unescape(s)
        now.parts.append(s)
        if any(t == "a" for t, _ in stack[-4:]):
            now.linked += len(s)

    def end() -> None:
        nonlocal now
        if now is not None and (t := " ".join("".join(now.parts).split())):
            now.text = t
            found.append(now)
        now = None

    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[6]
        if not name or (m[4] if m[2] else m[8]) != ">":
            continue
        tag, closing, rest = name.lower(), m[1] or m[5], m[3] or m[7] or ""
        if tag == "br":
            text(" ") if now is not None else None
        if tag in BREAKING:
            end()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in SILENT:
            if not (rest.endswith("/") and tag in FOREIGN):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else len(html) if tag in RAW else at
            continue
        if tag in VOID:
            continue
        over = CLOSED_BY.get(tag) or ({"p"} if tag in BREAKING else None)
        if over:
            for i in range(len(stack) - 1, max(-1, len(stack) - 8), -1):
                if stack[i][0] in over:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "div", "article", "section", "body"):
                    break
        words = tuple(w.lower() for a in _ATTRIBUTE.findall(rest) for w in _TOKEN.findall(a[1] or a[2] or a[3])) if rest else ()
        stack.append((tag, words))
    text(html[at:])
    end()
    return found


@lru_cache(100_000)
def _path_features(path: tuple) -> tuple[str, ...]:
    f = {f"in:{t}" for t, _ in path} | {f"word:{w}" for _, ws in path for w in ws}
    f |= {f"own:{path[-1][0]}"} if path else {"own:none"}
    box = [t for t, _ in path if t in ("article", "main", "section", "div", "aside", "nav", "header", "footer", "form", "body")]
    return tuple(sorted(f | {f"box:{'>'.join(box[-2:])}"}))


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        f = ["bias", *_path_features(b.path), f"size:{min(6, len(b.text).bit_length() // 2)}"]
        f += ["linked"] * (b.linked * 2 > len(b.text)) + ["stop"] * (b.text[-1] in ".!?…") + ["copyright"] * ("©" in b.text) + ["first"] * (i == 0) + ["last"] * (i == len(page) - 1)
        out.append(f)
    return out


#: Of the training pages, those whose boxes' names the field doesn't see, so that it learns to do without them.
NAMELESS = 0.15


def without_names(page: list[list[str]]) -> list[list[str]]:
    return [[f for f in block if not f.startswith(("word:", "box:"))] for block in page]


class Field:
    """Weights of features by label, and of steps between labels (0: not the article, 1: article)."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        self.weights, self.steps, self.start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)

    def label(self, page: list[Block]) -> list[int]:
        """Viterbi."""
        if not page:
            return []
        get, w = self.index.get, self.weights
        e = np.array([w[[j for f in fs if (j := get(f)) is not None]].sum(axis=0) for fs in features(page)])
        (a, b), back = (self.start + e[0]).tolist(), []
        (s00, s01), (s10, s11) = self.steps.tolist()
        for x, y in e[1:].tolist():
            back.append((a + s00 < b + s10, a + s01 < b + s11))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[str, list[int]]], rounds: int = 250, rate: float = 0.1, decay: float = 1e-5) -> Field:
    """The field of the greatest likelihood of pages' labels, one label for each block; by Adam, all pages at a time."""
    drop = random.Random(len(pages))
    found = [(without_names(features(blocks(h))) if drop.random() < NAMELESS else features(blocks(h)), np.array(y)) for h, y in pages]
    if any(len(f) != len(y) for f, y in found):
        raise ValueError("a label for each block is needed")
    found = [x for x in found if len(x[1])]
    field = Field(sorted({n for fs, _ in found for f in fs for n in f}))
    n, t = len(found), max(len(y) for _, y in found)
    rows, cols = [], []
    for i, (fs, _) in enumerate(found):
        for j, f in enumerate(fs):
            rows += [i * t + j] * len(f)
            cols += [field.index[x] for x in f]
    rows, cols = np.array(rows), np.array(cols)
    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size = np.array([len(y) for _, y in found])
    inside = np.arange(t)[None, :] < size[:, None]
    gold = np.zeros((n, t, 2))
    for i, (_, y) in enumerate(found):
        gold[i, np.arange(len(y)), y] = 1
    gold_steps = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    w = [field.weights, field.steps, field.start]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for k in range(1, rounds + 1):
        e = np.zeros((n * t, 2))
        e[rows[heads]] = np.add.reduceat(field.weights[cols], heads)
        e = e.reshape(n, t, 2)
        ahead, behind = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = field.start + e[:, 0]
        for j in range(1, t):
            step = _logsum(ahead[:, j - 1, :, None] + field.steps, 1) + e[:, j]
            ahead[:, j] = np.where(inside[:, j, None], step, ahead[:, j - 1])
        for j in range(t - 2, -1, -1):
            step = _logsum(field.steps + (e[:, j + 1] + behind[:, j + 1])[:, None, :], 2)
            behind[:, j] = np.where(inside[:, j + 1, None], step, 0)
        whole = _logsum(ahead[:, -1], 1)
        p = np.exp(ahead + behind - whole[:, None, None]) * inside[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + field.steps + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * inside[:, 1:, None, None]
        off = (gold - p).reshape(n * t, 2)
        g = np.stack([np.bincount(cols, off[rows, y], len(field.weights)) for y in (0, 1)], axis=1)
        grads = [g / n, (gold_steps - pair.sum(axis=(0, 1))) / n, (gold[:, 0] - p[:, 0]).mean(axis=0)]
        for i, (x, d) in enumerate(zip(w, grads, strict=True)):
            d = d - decay * x
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
            x += rate * m[i] / (1 - 0.9**k) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return field


#: Mark-ups of what is not the article: opening tag, closing tag. Fixed values.
ASIDE = [
    ("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="navigation">', "</div>"), ('<ul class="nav">', "</ul>"), ('<div class="breadcrumb">', "</div>"),
    ("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div id="masthead" class="site-header">', "</div>"), ("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="footer">', "</div>"),
    ("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<section class="widget">', "</section>"), ('<div class="related">', "</div>"), ('<div class="ad">', "</div>"), ('<div class="advert">', "</div>"), ('<div class="ads banner">', "</div>"), ('<div class="sponsored promo">', "</div>"), ('<p class="advertisement">', "</p>"),
    ('<div class="cookie-notice">', "</div>"), ('<div class="notice">', "</div>"), ('<div role="alert">', "</div>"), ('<div class="consent popup">', "</div>"), ("<form>", "</form>"), ('<div class="newsletter subscribe">', "</div>"), ('<div class="share social">', "</div>"),
    ('<section class="comments">', "</section>"), ('<div id="comments">', "</div>"), ('<div class="comment">', "</div>"), ('<ol class="comment-list">', "</ol>"), ('<div role="navigation">', "</div>"), ('<div class="login">', "</div>"), ('<dialog>', "</dialog>"),
    ('<section class="responses">', "</section>"), ('<div class="gdpr">', "</div>"), ('<div class="tags">', "</div>"), ('<div class="topbar">', "</div>"), ('<div class="legal copyright">', "</div>"),
]
#: Mark-ups of what holds the article. Fixed values.
MAIN = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post entry">', "</div>"),
    ('<div id="content"><div class="article-body">', "</div></div>"), ('<section class="story text">', "</section>"), ("<article><section>", "</section></article>"), ('<div role="main">', "</div>"),
]


#: Of the pages made for training, those whose article stands in the body without a box of its own, and those that have no
#: body, menus or anything else about it.
BOXLESS, BARE = 0.12, 0.04


def labelled_pages(n: int = 1000, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages made from the templates, with a label for each of their blocks."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9))) for _ in range(r.randint(a, b)))

    def side() -> tuple[str, int]:
        a, b = r.choice(ASIDE)
        kind = r.random()
        if "form" in a or kind < 0.1:
            return f"{a}<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>{b}", 2
        if "<ul" in a or "<ol" in a or kind < 0.45:
            k = r.randint(1, 6)
            items = "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(k))
            return (f"{a}{items}{b}" if "<ul" in a or "<ol" in a else f"{a}<ul>{items}</ul>{b}"), k
        if kind < 0.7 or a.startswith("<p"):
            return f"{a}{r.choice(['', '&copy; '])}{words(1, 25)}{r.choice(['', '.'])}{b}", 1
        k = r.randint(1, 4)
        return a + "".join(f"<p>{words(2, 40)}.</p>" for _ in range(k)) + b, k

    pages = []
    for _ in range(n):
        kind = r.random()
        bare, boxless = kind < BARE, kind < BARE + BOXLESS
        html, y = [] if bare else ["<!DOCTYPE html><html><head><title>x</title></head><body>"], []
        for _ in range(0 if bare else r.randint(0, 5)):
            h, k = side()
            html.append(h)
            y += [0] * k
        a, b = ("", "") if boxless else r.choice(MAIN)
        html.append(a)
        for tag in [*r.choice([["h1"], ["h2"], []]), *r.choices(["p", "p", "p", "p", "p", "h2", "h3", "blockquote", "pre", "li", "td", "div", "side", "side", "open"], k=r.randint(1, 12))]:
            tag = "p" if boxless and tag == "open" else tag
            if tag == "side" and bare:
                y.append(1)
                html.append(f"{words(4, 40)}.<hr>")  # text outside any element
                continue
            if tag == "side":
                h, k = side()
                html.append(h)
                y += [0] * k
                continue
            y.append(1)
            text = words(1, 3) if r.random() < 0.25 else words(4, 60)
            text += r.choice([".", ".", ".", "", "!", " ***", " &amp;"])
            wrap = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>", "open": "<p><b>{}<br>"}.get(tag, f"<{tag}>{{}}</{tag}>")
            html.append(wrap.format(text if r.random() < 0.7 else f"<a href=x>{words(1, 2)}</a> {text}"))
        html.append(b)
        for _ in range(0 if bare else r.randint(0, 5)):
            h, k = side()
            html.append(h)
            y += [0] * k
        pages.append(("".join(html if bare else [*html, "</body></html>"]), y))
    return pages


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, keep in zip(page, field.label(page), strict=True) if keep)


def extracted(pages: DataFrame, field: Field) -> DataFrame:
    """row (pages' columns), text."""

    def make():
        return lambda htmls: [[main_text(h, field) for h in htmls]]

    return map_texts(pages, "html", "text string", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), train(labelled_pages()))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
