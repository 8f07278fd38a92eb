"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the runs of text that no block-level tag
interrupts, each with its open ancestors. Features are the ancestors' tags, the
parts of their class and id names, and the block's text (links, length, marks,
sentences, place, the length of its neighbours). A two-label chain (main text or not), trained on labelled pages by
maximum likelihood, gives each block a label by Viterbi decoding.

The labelled pages are made here by ``labelled_pages``: many layouts of the
containers in which articles and what surrounds them are commonly put, with
random words, so no page of the tables is learned from. A share of the
containers has names without a meaning, so that the shape of text and the place
must do where names are unknown.

Edge cases: null and empty html give no block and the empty text; scripts,
styles, comments and the head are never text; unclosed tags and comments end
with the page; repeated rows give equal results.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, only

#: Fixed values of the HTML vocabulary.
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video title textarea".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div dl fieldset footer form header main nav ol section table ul".split())

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|/([a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*>|([a-zA-Z][^\s/>]*)([^>]*)>)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def leaf_blocks(page: str | None) -> list[Block]:
    """In page order. path: the open elements, outermost first, each a tag and its name parts."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    links = linked = at = 0

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(tuple(stack), text, linked))
            held.clear()
        linked = 0

    find, low = _TAG.search, None
    while m := find(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            linked += len(piece) * bool(links)
        at = m.end()
        tag = m[1] or m[4]
        if tag:
            tag, attributes = tag.lower(), m[2] if m[1] else m[5]
            if tag in SILENT and not attributes.endswith("/"):
                low = low if low is not None else page.lower()
                end = low.find(f"</{tag}", at)
                if end < 0:
                    at = len(page)
                    break
                k = page.find(">", end)
                at = len(page) if k < 0 else k + 1
                continue
            if tag in INLINE:
                if tag == "a":
                    links = 1
                elif tag == "br":
                    held.append(" ")
                continue
            close()
            links = 0
            if tag in VOID:
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE:
                        break
            stack.append((tag, _parts(attributes)))
        elif m[3]:
            tag = m[3].lower()
            if tag in INLINE:
                if tag == "a":
                    links = 0
                continue
            close()
            links = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
    if at < len(page):
        # An opened tag that never ends is no text.
        rest = page[at:]
        k = re.search(r"<[a-zA-Z/!?]", rest)
        held.append(rest[: k.start()] if k else rest)
    close()
    return [b for b in out if not any(t == "head" for t, _ in b.path)]


_part_memo: dict[str, tuple[str, ...]] = {}


def _parts(attributes: str) -> tuple[str, ...]:
    if not attributes:
        return ()
    got = _part_memo.get(attributes)
    if got is None:
        names = {p.lower() for m in _NAMES.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or "")}
        if _HIDDEN.search(attributes):
            names.add("hidden")
        got = tuple(sorted(names))
        if len(_part_memo) > 20_000:
            _part_memo.clear()
        _part_memo[attributes] = got
    return got


def path_features(path: tuple) -> list[str]:
    out = {"bias"}
    inside = ""
    for tag, names in path:
        out.add(f"in {tag}")
        for n in names:
            out.add(f"name {n}")
            out.add(f"stem {n[:5]}")
        if tag in ("article", "main", "aside", "nav", "header", "footer", "form", "section"):
            inside = tag if not inside else f"{inside}>{tag}"
    out.add(f"under {inside}")
    if path:
        out.add(f"own {path[-1][0]}")
    return sorted(out)


_MARKS = (("copyright", re.compile(r"[©®]")), ("cookie", re.compile(r"(?i)\bcookies?\b|\bprivacy\b|\bgdpr\b")), ("sentence", re.compile(r"[.!?…][\"'»”)]*$")), ("date", re.compile(r"\d{4}[-/]\d\d?[-/]\d\d?")), ("bars", re.compile(r"[|·•»›] ")), ("said", re.compile(r"^[A-Z]\w+(?: \w+)?(?: (?:wrote|says|said|replied))?: ")), ("ask", re.compile(r"(?i)\b(subscribe|sign up|log ?in|newsletter|share this|advertisement|sponsored|reply|read more|comments?)\b")))


_END = re.compile(r"[.!?…][\"'»”)]* |[.!?…][\"'»”)]*$")


def _size(block: Block | None) -> int:
    return -1 if block is None else min(6, int(math.log2(len(block.text) + 1)) // 2)


def text_features(block: Block, k: int, n: int, before: Block | None = None, after: Block | None = None) -> list[str]:
    t = block.text
    share = min(1.0, block.linked / max(1, len(t)))
    out = [f"links {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"size {_size(block)}", f"ends {min(4, len(_END.findall(t)))}", f"before {_size(before)}", f"after {_size(after)}", "first" if not k else "last" if k == n - 1 else "mid"]
    out += [f"mark {name}" for name, p in _MARKS if p.search(t)]
    return out


class Chain:
    """Two-label linear chain; label 1 is main text."""

    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.weight = dict(zip(names, weights.tolist(), strict=True))  # of label 1 over label 0
        self.moves, self.start = moves.tolist(), start.tolist()
        self.memo: dict[tuple, float] = {}

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.15, l2: float = 1e-3) -> Chain:
        """By maximum likelihood: forward-backward over all pages at once, and adaptive descent."""
        pages = [p for p in pages if p[1]]
        names = sorted({f for rows, _ in pages for r in rows for f in r})
        index = {f: k for k, f in enumerate(names)}
        p, t = len(pages), max(len(y) for _, y in pages)
        y = np.zeros((p, t), int)
        real = np.zeros((p, t), bool)
        spot, feat = [], []
        for i, (rows, labels) in enumerate(pages):
            y[i, : len(labels)], real[i, : len(labels)] = labels, True
            for j, r in enumerate(rows):
                spot += [i * t + j] * len(r)
                feat += [index[f] for f in r]
        spot, feat = np.array(spot), np.array(feat)
        x = np.zeros(len(names) + 6)
        m1, m2 = np.zeros_like(x), np.zeros_like(x)
        total = real.sum()
        for step in range(1, steps + 1):
            w, moves, start = x[:-6], x[-6:-2].reshape(2, 2), x[-2:]
            e = np.zeros((p, t, 2))
            e[:, :, 1] = np.bincount(spot, w[feat], p * t).reshape(p, t)
            a, b = np.zeros((p, t, 2)), np.zeros((p, t, 2))
            a[:, 0] = e[:, 0] + start
            for k in range(1, t):
                a[:, k] = e[:, k] + np.logaddexp(a[:, k - 1, :1] + moves[0], a[:, k - 1, 1:] + moves[1])
                a[:, k] = np.where(real[:, k, None], a[:, k], a[:, k - 1])
            for k in range(t - 2, -1, -1):
                s = e[:, k + 1] + b[:, k + 1]
                v = np.logaddexp(moves[:, 0] + s[:, :1], moves[:, 1] + s[:, 1:])
                b[:, k] = np.where(real[:, k + 1, None], v, 0)
            z = np.logaddexp(a[:, 0, 0] + b[:, 0, 0], a[:, 0, 1] + b[:, 0, 1])
            post = np.exp(a + b - z[:, None, None])
            off = np.where(real, post[:, :, 1] - y, 0)
            g_w = np.bincount(feat, off.ravel()[spot], len(names))
            g_m = np.zeros((2, 2))
            two = real[:, 1:]
            for u in (0, 1):
                for v in (0, 1):
                    q = np.exp(a[:, :-1, u] + moves[u, v] + e[:, 1:, v] + b[:, 1:, v] - z[:, None])
                    g_m[u, v] = np.where(two, q - ((y[:, :-1] == u) & (y[:, 1:] == v)), 0).sum()
            g_s = np.array([(post[:, 0, u] - (y[:, 0] == u)).sum() for u in (0, 1)])
            grad = np.concatenate((g_w, g_m.ravel(), g_s)) / total + l2 * x / 10
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
            x = x - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        return cls(names, x[:-6], x[-6:-2].reshape(2, 2), x[-2:])

    def label(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        n = len(blocks)
        if not n:
            return []
        get, (m0, m1), back = self.weight.get, self.moves, []
        s0, s1 = self.start
        for k, b in enumerate(blocks):
            e = self.memo.get(b.path)
            if e is None:
                if len(self.memo) > 20_000:
                    self.memo.clear()
                e = self.memo[b.path] = sum(get(f, 0.0) for f in path_features(b.path))
            e += sum([get(f, 0.0) for f in text_features(b, k, n, blocks[k - 1] if k else None, blocks[k + 1] if k + 1 < n else None)])
            if k:
                a, c = s0 + m0[0], s1 + m1[0]
                u, v = s0 + m0[1], s1 + m1[1]
                back.append((int(c > a), int(v > u)))
                s0, s1 = max(a, c), max(u, v) + e
            else:
                s1 += e
        out = [int(s1 > s0)]
        for w in reversed(back):
            out.append(w[out[-1]])
        return out[::-1]


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, chain.label(blocks), strict=True) if y)


_SIDE_BOXES = (
    ("nav", ""), ("nav", 'class="main-menu"'), ("div", 'class="menu"'), ("div", 'id="navigation"'), ("ul", 'class="breadcrumb"'), ("div", 'class="navbar"'), ("div", 'role="navigation"'),
    ("header", ""), ("div", 'id="header"'), ("header", 'class="site-header"'), ("div", 'class="masthead"'), ("div", 'class="topbar"'), ("header", 'role="banner"'),
    ("footer", ""), ("div", 'id="footer"'), ("footer", 'class="site-footer"'), ("div", 'class="copyright"'), ("div", 'class="legal"'),
    ("aside", ""), ("aside", 'class="sidebar"'), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="widget"'), ("div", 'class="related-posts"'), ("section", 'class="related"'), ("div", 'class="recommended"'), ("div", 'class="popular"'),
    ("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="advertisement"'), ("div", 'class="banner"'), ("div", 'class="sponsored"'), ("div", 'class="promo"'), ("aside", 'class="ad-slot"'), ("section", 'class="sponsor"'), ("div", 'id="ad-top"'), ("p", 'class="ad"'), ("p", 'class="advert"'),
    ("div", 'class="cookie-notice"'), ("div", 'class="cookie-banner"'), ("div", 'id="cookie-consent"'), ("div", 'class="notice"'), ("div", 'class="alert"'), ("div", 'class="popup"'), ("div", 'class="modal"'), ("div", 'role="dialog"'), ("div", 'class="gdpr"'), ("p", 'class="notice"'), ("section", 'class="cookies"'),
    ("form", ""), ("form", 'class="newsletter"'), ("div", 'class="subscribe"'), ("div", 'class="search"'), ("form", 'class="login"'), ("div", 'class="signup"'), ("fieldset", ""),
    ("div", 'class="comments"'), ("section", 'class="comments"'), ("div", 'id="comments"'), ("section", 'id="comments"'), ("ol", 'class="comment-list"'), ("div", 'class="comment"'), ("div", 'class="reader-comments"'), ("ul", 'class="commentlist"'), ("div", 'id="disqus_thread"'), ("div", 'class="discussion"'), ("div", 'class="replies"'), ("div", 'class="responses"'), ("aside", 'class="comments"'), ("article", 'class="comment"'),
    ("div", 'class="cmts"'), ("div", 'class="cmt-list"'), ("div", 'id="cmt"'), ("div", 'class="reactions"'), ("div", 'class="feedback"'), ("div", 'class="discuss"'), ("div", 'class="disc"'), ("div", 'class="thread"'), ("section", 'class="user-opinions"'),
    ("div", 'class="promo-box"'), ("div", 'class="adbox"'), ("div", 'class="teaser"'), ("div", 'class="upsell"'), ("div", 'class="dfp"'), ("div", 'class="partner"'),
    ("div", 'class="share"'), ("div", 'class="social"'), ("div", 'class="pagination"'), ("div", 'class="tags"'), ("div", 'hidden'), ("div", 'style="display:none"'), ("div", 'role="complementary"'), ("div", 'role="contentinfo"'),
)
_MAIN_BOXES = (("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="article-body"'), ("div", 'class="post-content"'), ("section", 'class="story"'), ("div", 'class="entry"'), ("div", 'class="main-text"'), ("div", 'itemprop="articleBody" class="article"'), ("div", ""))


def labelled_pages(count: int = 1000, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages and the label of each of their blocks, in order."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n p r s t v z th st".split() for b in "a e i o u an er in on".split()]

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3))))

    def prose(n: int) -> str:
        out = []
        while n > 0:
            k = min(n, r.randint(1, 14))
            out.append(" ".join(word() for _ in range(k)).capitalize() + r.choice((".", ".", ".", "!", "?", "")))
            n -= k
        return " ".join(out)

    def nameless(attributes: str, share: float) -> str:
        """Now and then a name without a meaning, or none."""
        return attributes if r.random() > share else r.choice(("", f'class="{"".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(2, 4)))}-{r.randint(1, 99)}"', f'id="{r.choice("qxzwk")}{r.randint(1, 999)}"'))

    def said() -> str:
        return f"{word().capitalize()}{r.choice((':', ' wrote:', ' says:', ' replied:'))} {prose(r.randint(2, 14))}"

    def side(tag: str, attributes: str, blank: bool = False) -> tuple[str, list[int]]:
        kind = r.random()
        n = r.randint(1, 5)
        if blank:
            tag = "div"
        if tag == "div" and (blank or r.random() < 0.25):
            # Without a name that tells: links, or what readers wrote.
            attributes = nameless(attributes, 1.0)
            kind = r.choice((0.1, 0.1, 0.99))
            if kind > 0.9:
                return f"<{tag} {attributes}>" + "".join(f"<{(t := r.choice(('p', 'div')))}>{said()}</{t}>" for _ in range(n)) + f"</{tag}>", [0] * n
        if tag in ("ul", "ol"):
            return f"<{tag} {attributes}>" + "".join(f"<li>{'<a href=x>' * (k := r.random() < 0.6)}{prose(r.randint(1, 15))}{'</a>' * k}</li>" for _ in range(n)) + f"</{tag}>", [0] * n
        if tag == "p":
            return f"<p {attributes}>{prose(r.randint(2, 25))}</p>", [0]
        if kind < 0.35:
            return f"<{tag} {attributes}><ul>" + "".join(f'<li><a href="/{word()}">{prose(r.randint(1, 4))}</a></li>' for _ in range(n)) + f"</ul></{tag}>", [0] * n
        if kind < 0.65:
            extra = r.choice(("", "", "", "&copy; 2024 ", "We use cookies. ", "Advertisement: ", "Subscribe to our newsletter. ", "Share this ", "Reply "))
            return f"<{tag} {attributes}>{extra}{prose(r.randint(1, 25))}</{tag}>", [0]
        body = "".join(f"<{(t := r.choice(('p', 'p', 'h3', 'div')))}>{prose(r.randint(1, 30))}</{t}>" for _ in range(n))
        return f"<{tag} {attributes}>{body}</{tag}>", [0] * n

    pages = []
    for _ in range(count):
        parts: list[tuple[str, list[int]]] = []
        blank = r.random() < 0.15  # no name on the page says anything
        some = lambda least, most: [side(*r.choice(_SIDE_BOXES), blank) for _ in range(r.randint(least, most))]
        parts += some(0, 4)
        tag, attributes = r.choice(_MAIN_BOXES)
        if tag == "div" or blank:
            tag, attributes = "div", nameless(attributes, 1.0 if blank else 0.4)
        elif r.random() < 0.06:
            tag, attributes = r.choice((("div", nameless("", 1.0)), ("td", "")))
        body: list[tuple[str, list[int]]] = []
        if r.random() < 0.85:
            head = f"<h1>{prose(r.randint(1, 9))}</h1>"
            body.append((f"<header>{head}</header>" if r.random() < 0.15 and tag == "article" else head, [1]))
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            k = r.random()
            text = prose(r.choice((1, 2, 5, 20, 40, 90, 150)))
            if k < 0.15:
                body.append((f"<p><b>{text}<br>", [1]))
            elif k < 0.65:
                body.append((f"<p>{text if r.random() < 0.8 else text + f' <a href=y>{prose(2)}</a> ' + prose(6)}</p>", [1]))
            elif k < 0.75:
                body.append((f"<h{r.randint(2, 4)}>{prose(r.randint(1, 8))}</h2>".replace("</h2>", "</h2>"), [1]))
            elif k < 0.83:
                n = r.randint(1, 4)
                body.append((f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{prose(r.randint(1, 20))}</li>" for _ in range(n)) + f"</{t}>", [1] * n))
            elif k < 0.88:
                body.append((f"<blockquote>{'<p>' * (q := r.random() < 0.5)}{text}{'</p>' * q}</blockquote>", [1]))
            elif k < 0.91:
                body.append((f"<figure><img src=a><figcaption>{prose(8)}</figcaption></figure>", [1]))
            elif k < 0.94:
                body.append((f"<table><tr><td>{prose(2)}</td><td>{prose(3)}</td></tr></table>", [1, 1]))
            elif k < 0.97:
                body.append((f"<pre>{text}</pre>", [1]))
            else:
                body.append((f"<div>{text}</div>", [1]))
        if r.random() < 0.45:
            body.insert(r.randint(0, len(body)), side(*r.choice(_SIDE_BOXES)))
        if r.random() < 0.2:
            body.append(side(*r.choice([b for b in _SIDE_BOXES if "omment" in b[1]])))
        whole = f"<{tag} {attributes}>" + "".join(b[0] for b in body) + f"</{tag}>"
        labels = [y for b in body for y in b[1]]
        if tag == "td":
            n = r.randint(0, 4)
            whole = "<table><tr><td>" + "".join(f"<a href=/{word()}>{prose(1)}</a><{r.choice(('br', 'p'))}>" for _ in range(n)) + f"</td>{whole}</tr></table>"
            labels = [0] * (len(leaf_blocks(whole)) - len(labels)) + labels
        parts.append((whole, labels))
        parts += some(0, 4)
        wrap = r.choice(("", "", "<div>", '<div class="wrapper">', '<div id="page">'))
        page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + wrap + "".join(p[0] for p in parts) + "</div>" * bool(wrap) + "</body></html>"
        labels = [y for p in parts for y in p[1]]
        if len(leaf_blocks(page)) == len(labels):
            pages.append((page, labels))
    return pages


def train(pages: list[tuple[str, list[int]]] | None = None) -> Chain:
    rows = []
    for page, labels in pages if pages is not None else labelled_pages():
        blocks = leaf_blocks(page)
        around = [None, *blocks, None]
        rows.append(([path_features(b.path) + text_features(b, k, len(blocks), around[k], around[k + 2]) for k, b in enumerate(blocks)], labels))
    return Chain.fit(rows)


def extract(pages: DataFrame, chain: Chain | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page row: page_id, url, text (blocks of main text joined by line feeds), n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or train())
    rows = only(pages, page_id, url, html).toDF("page_id", "url", "html")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            t = [main_text(p, c) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64())], ["page_id", "url", "text", "n_chars"])

    s = rows.schema
    return by_batch(rows, go, f"page_id {s['page_id'].dataType.simpleString()}, url {s['url'].dataType.simpleString()}, text string, n_chars long")
