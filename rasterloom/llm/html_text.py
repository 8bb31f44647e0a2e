"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, with the path of open
block-level tags and their class and id words.  Scripts, styles, other raw elements,
comments and the head give no blocks.  Every block becomes a vector: hashed tags and class
words of its path, hashed words of its text, length, link share, punctuation and place.  A
bidirectional LSTM in numpy reads the sequence of a page's blocks, so each is labelled in
the context of the whole page, and those with a probability of one half or more are the
text, in page order, joined by two line feeds.

The labeller is trained on ``TRAIN_PAGES`` pages that ``make_page`` writes: random layouts
of menus, headers, notices, adverts, sidebars, forms, comments and footers around an article,
with and without telling tags, each block with its label.  The seed is fixed, so every call
has the same weights.

Defined cases: a null or empty page has the empty text; unclosed and unmatched tags are
tolerated; a page of any length and any nesting is read whole, in time linear in its length (of a path
of more than 48 tags the vectors know the outer and inner 24); repeated rows are handled each; an empty
table gives no rows; further columns pass through unless they clash with text or n_chars.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as tx

TRAIN_PAGES, EPOCHS, BATCH, HIDDEN = 1200, 8, 24, 16
SEED = 11
SLICE_BYTES = 1 << 20

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; those of RAW_TEXT hold no tags and may run to the end of the page.
RAW_TEXT = frozenset("script style textarea".split())
RAW_TAGS = frozenset("noscript template svg math iframe select object canvas audio video button".split())
HEAD_TAGS = frozenset("html head title meta link base script style noscript template".split())

_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TEXT}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOPS = re.compile(r"[<>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

#: Numbers that are labelled at once, blocks whose vectors are made at once, outer and inner tags of a path, and text read in vain for ends of tags, in pages.
CELLS, CHUNK, PATH, VAIN = 2_000_000, 2048, 24, 4

N_TAG, N_CLASS, N_LAST, N_TEXT, N_PLAIN = 128, 384, 64, 32, 5
WIDTH = N_TAG + N_CLASS + N_LAST + N_TEXT + N_PLAIN


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


class _Tags:
    """The tags and comments of a page in order, in time linear in its length.

    A tag ends at the first > outside quotes, unless a < stands before that or a quote is not
    closed; then at the first > of all.  Text that is read for the first rule in vain is counted,
    and beyond ``VAIN`` times the page only the second rule is used.
    """

    def __init__(self, page: str):
        self.page, self.at, self.last, self.vain = page, 0, page.rfind(">"), VAIN * len(page)

    def _end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at ``at``."""
        page, i = self.page, at
        while self.vain > 0 and (m := _STOPS.search(page, i)) is not None:
            i = m.end()
            if m[0] == ">":
                return i - 1
            if m[0] == "<":
                break
            i = page.find(m[0], i) + 1
            if not i:
                i = len(page)
                break
        self.vain -= i - at
        return page.find(">", at)

    def next(self) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag in small letters, whether it closes, attributes); the tag is ! for comments and declarations."""
        page = self.page
        while (start := page.find("<", self.at)) >= 0:
            if page.startswith("<!--", start) or start > self.last:
                start = page.find("<!--", start)  # where no > follows, only a comment does not need one
                if start < 0:
                    return None
                end = page.find("-->", start + 4)
                self.at = end + 3 if end >= 0 else len(page)
                return start, self.at, "!", False, ""
            if page.startswith(("<!", "<?"), start):
                self.at = page.find(">", start) + 1
                return start, self.at, "!", False, ""
            m = _NAME.match(page, start)
            if m is None:
                self.at = start + 1
                continue
            end = self._end(m.end())
            self.at = end + 1
            return start, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
        return None


def _tokens(page: str) -> list[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, whether it closes, attributes) in order; tag is None for what gives only a blank.

    An element of RAW_TAGS that is closed before its parent is one blank; an unclosed one keeps its tag.
    """
    out: list[tuple[int, int, str | None, bool, str]] = []
    opened: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    tags = _Tags(page)
    while (one := tags.next()) is not None:
        begin, at, tag, shut, attributes = one
        if tag == "!":
            out.append(one)
            continue
        if tag in RAW_TEXT and not shut:
            end = None if attributes.endswith("/") else _RAW_END[tag].search(page, at)
            at = tags.at = at if attributes.endswith("/") else end.end() if end else len(page)
            out.append((begin, at, None, False, ""))
            continue
        if tag in RAW_TAGS and not shut and attributes.endswith("/"):
            out.append((begin, at, None, False, ""))
            continue
        if tag in RAW_TAGS or tag in BLOCK_TAGS and tag not in VOID_TAGS:
            if not shut:
                opened.append((tag, len(out)))
                count[tag] += 1
            elif count[tag]:
                while True:
                    top, k = opened.pop()
                    count[top] -= 1
                    if top == tag:
                        break
                if tag in RAW_TAGS:
                    start = out[k][0]
                    del out[k:]
                    out.append((start, at, None, False, ""))
                    continue
        out.append((begin, at, tag, shut, attributes))
    return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; ``path`` holds (tag, class and id words) from the outside in, the ``PATH`` outermost and innermost."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each open tag in the stack
    held: list[str] = []
    anchors, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text and not (places["head"] or places["title"]):
                path = stack if len(stack) <= 2 * PATH else stack[:PATH] + stack[-PATH:]
                out.append(Block(text, tuple(path), min(linked, len(text))))
            held.clear()
            linked = 0

    def close(tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """Closes the innermost of ``tags``, unless one of ``stop`` stands before it."""
        at = -1
        for t in tags:
            if places[t]:
                at = max(at, places[t][-1])
        if at < 0 or any(places[t] and places[t][-1] > at for t in stop):
            return
        flush()
        for t, _ in stack[at:]:
            places[t].pop()
        del stack[at:]

    at, hidden = 0, False
    for start, end, tag, shut, attributes in _tokens(page):
        if start > at and not hidden:
            held.append(page[at:start])
            linked += (start - at) * (anchors > 0)
        at = end
        if tag == "!":
            continue
        if tag is None or tag in RAW_TAGS:
            held.append(" ")
            linked += anchors > 0
            hidden = hidden or tag is not None and not shut
            if tag is None or tag in HEAD_TAGS:
                continue
        if tag in BLOCK_TAGS:
            hidden = False  # an unclosed raw element ends here
        if not shut and tag not in HEAD_TAGS:
            if tag in BLOCK_TAGS or not (stack and stack[-1][0] == "title"):
                close(("head",), ())
            if tag in BLOCK_TAGS:
                close(("title",), ())
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            anchors = max(0, anchors - 1) if shut else 1
        elif tag in BLOCK_TAGS:
            flush()
            if shut:
                close((tag,), () if tag != "p" else ("div", "article", "section", "td", "li"))
            else:
                close(("p",), ("td", "th", "li", "div", "article", "section", "body"))
                if tag == "li":
                    close(("li",), ("ul", "ol", "menu"))
                elif tag in ("dt", "dd"):
                    close(("dt", "dd"), ("dl",))
                elif tag in ("td", "th"):
                    close(("td", "th"), ("tr", "table"))
                elif tag == "tr":
                    close(("tr",), ("table",))
                if tag not in VOID_TAGS:
                    words = tuple(_WORD.findall(" ".join(filter(None, (a or b or c for a, b, c in _NAMES.findall(attributes)))).lower()))
                    places[tag].append(len(stack))
                    stack.append((tag, words))
    if not hidden:
        held.append(page[at:])
    flush()
    return out


def _slot(s: str, n: int) -> int:
    return zlib.crc32(s.encode()) % n


@lru_cache(1 << 13)
def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(N_TAG + N_CLASS + N_LAST, np.float32)
    for depth, (tag, words) in enumerate(path):
        if tag not in ("html", "body"):
            v[_slot(tag, N_TAG)] = 1
        for w in words:
            v[N_TAG + _slot(w, N_CLASS)] = 1
        if depth == len(path) - 1:
            v[N_TAG + N_CLASS + _slot(tag, N_LAST)] = 1
    return v


def vectors(found: list[Block], place: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
    """A row for each block; ``place`` and ``total`` are its number on its page and the page's number of blocks."""
    place = np.arange(len(found)) if place is None else place
    total = np.full(len(found), len(found)) if total is None else total
    out = np.zeros((len(found), WIDTH), np.float32)
    if not found:
        return out
    words = tx.Words(pa.array([b.text for b in found], pa.large_string()))
    h = words.hashes(lower=True)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    np.add.at(out, (words.doc, N_TAG + N_CLASS + N_LAST + (h % np.uint64(N_TEXT)).astype(np.int64)), sign)
    text = out[:, N_TAG + N_CLASS + N_LAST : -N_PLAIN]
    text /= np.maximum(np.linalg.norm(text, axis=1, keepdims=True), 1)
    for i, b in enumerate(found):
        out[i, : N_TAG + N_CLASS + N_LAST] = _path_vector(b.path)
        n = len(b.text)
        out[i, -N_PLAIN:] = np.log1p(n) / 6, b.linked / n, min(1, 10 * sum(map(b.text.count, ".,;!?")) / n), place[i] / total[i], 1 / (1 + total[i])
    return out


class Labeller:
    """A bidirectional LSTM with one output per step; arrays are (step, page, feature)."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        rnd = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"W{d}"] = (rnd.standard_normal((WIDTH, 4 * hidden)) * 0.15).astype(np.float32)
            self.p[f"U{d}"] = (rnd.standard_normal((hidden, 4 * hidden)) * 0.2).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"b{d}"][hidden : 2 * hidden] = 1  # forget gates start open
        self.p["V"] = (rnd.standard_normal((2 * hidden, 1)) * 0.2).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, live: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        steps, n, k = x.shape[0], x.shape[1], self.hidden
        z_in = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, kept = np.zeros((steps, n, k), np.float32), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ self.p[f"U{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * k]))
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(z[:, 3 * k :])
            m = live[t][:, None]
            new = f * c + i * g
            kept[t] = (h, c, i, f, o, g, new, m)
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[t] = h
        return out, kept

    def forward(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, kf = self._run(x, live, "f")
        b, kb = self._run(x, live, "b")
        both = np.concatenate([f, b], axis=2)
        score = (both @ self.p["V"] + self.p["c"])[:, :, 0]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30))), (both, kf, kb)

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, (both, kf, kb) = self.forward(x, live)
        e = ((prob - y) * live / live.sum()).astype(np.float32)[:, :, None]
        k, out = self.hidden, {"V": np.einsum("tnk,tno->ko", both, e), "c": e.sum(axis=(0, 1))}
        into = e @ self.p["V"].T
        for d, kept, part in (("f", kf, into[:, :, :k]), ("b", kb, into[:, :, k:])):
            steps, n = x.shape[:2]
            dz_all = np.zeros((steps, n, 4 * k), np.float32)
            dU = np.zeros_like(self.p[f"U{d}"])
            dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h0, c0, i, f, o, g, new, m = kept[t]
                dh = dh + part[t]
                own, th = np.where(m, dh, 0), np.tanh(new)
                dnew = np.where(m, dc, 0) + own * o * (1 - th * th)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), own * th * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                dU += h0.T @ dz
                dh = np.where(m, 0, dh) + dz @ self.p[f"U{d}"].T
                dc = np.where(m, dnew * f, dc)
            out[f"W{d}"] = np.einsum("tnw,tnk->wk", x, dz_all, optimize=True)
            out[f"U{d}"], out[f"b{d}"] = dU, dz_all.sum(axis=(0, 1))
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """What both directions take from the vectors: all that is kept of a block while its page is read."""
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"], axis=1)

    def _read(self, z_in: np.ndarray, live: np.ndarray, d: str) -> np.ndarray:
        """As ``_run``, on projected blocks, without what training keeps."""
        steps, n, k = z_in.shape[0], z_in.shape[1], self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.zeros((steps, n, k), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ self.p[f"U{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * k]))
            m = live[t][:, None]
            c = np.where(m, gates[:, k : 2 * k] * c + gates[:, :k] * np.tanh(z[:, 3 * k :]), c)
            h = np.where(m, gates[:, 2 * k :] * np.tanh(c), h)
            out[t] = h
        return out

    def label_projected(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities for each block of each page; pages of like length run together, ``CELLS`` numbers at once, one page at least."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        width, at = 8 * self.hidden, 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(pages[order[to]]) * width <= CELLS:
                to += 1
            own, at = order[at:to], to
            z, live = stacked([pages[i] for i in own])
            if z.shape[0]:
                half = width // 2
                both = np.concatenate([self._read(z[:, :, :half], live, "f"), self._read(z[:, :, half:], live, "b")], axis=2)
                prob = 1 / (1 + np.exp(-np.clip((both @ self.p["V"] + self.p["c"])[:, :, 0], -30, 30)))
                for j, i in enumerate(own):
                    out[i] = prob[: len(pages[i]), j]
        return out

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        return self.label_projected([self.project(p) for p in pages])


def stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages), default=0)
    x, live = np.zeros((steps, len(pages), pages[0].shape[1] if pages else WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], live[: len(p), j] = p, True
    return x, live


_SYLLABLES = "an er the in on re ti es st en at ed ha le ou que de la el os as al ung sch ein ver ge be keit lich tion ment ci do ra mi".split()
_CHROME_WORDS = "home about contact login subscribe copyright cookies accept share reply comments advertisement sponsored related privacy terms search menu newsletter next previous".split()
_GOOD_CLASSES = "content post entry article body text story main page prose markdown".split()
_BAD = {
    "nav": "nav menu navbar navigation breadcrumb links toc pagination".split(),
    "header": "header masthead banner top topbar branding".split(),
    "aside": "sidebar aside widget related recommended rail promo".split(),
    "ad": "ad ads advert advertisement sponsor sponsored banner promo".split(),
    "notice": "cookie notice consent alert popup modal gdpr newsletter subscribe".split(),
    "comments": "comments comment replies reply discussion respond disqus".split(),
    "form": "form login search signup subscribe".split(),
    "footer": "footer copyright bottom legal credits colophon".split(),
    "share": "share social tags meta byline author".split(),
}


def make_page(rnd: random.Random) -> str:
    """A random page; the text of article blocks begins with \\x01, that of all others with \\x02."""

    def words(n: int) -> str:
        return " ".join("".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n))

    def prose(mark: str, lo: int = 3, hi: int = 60) -> str:
        end = rnd.choice([".", ".", "", "***", "?"])
        return f"{mark}{words(rnd.randint(lo, hi)).capitalize()}{end}"

    def junk() -> str:
        said = " ".join(rnd.sample(_CHROME_WORDS, rnd.randint(1, 3))) if rnd.random() < 0.4 else words(rnd.randint(1, 14))
        return f"\x02{said}"

    def name(kind: str) -> str:
        pool = _BAD[kind]
        n = rnd.choice(pool)
        return rnd.choice([n, f"{n}-{rnd.choice(['box', 'wrap', 'list', 'area', 'item'])}", f"site-{n}", f"{n} {rnd.choice(pool)}"])

    def boiler(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "aside": "aside", "footer": "footer", "form": "form"}.get(kind)
        bare = tag and rnd.random() < 0.6
        attr = "" if bare and rnd.random() < 0.6 else f' {rnd.choice(["class", "class", "id"])}="{name(kind)}"'
        tag = tag if bare else rnd.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        if kind in ("nav", "share") or rnd.random() < 0.25:
            items = "".join(f'<li><a href="/x">{junk()}</a></li>' for _ in range(rnd.randint(2, 7)))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "comments":
            inner = "".join(f'<div{rnd.choice([" class=" + chr(34) + "comment" + chr(34), ""])}>{rnd.choice(["<p>", ""])}{prose(chr(2), 1)}</div>' if rnd.random() < 0.7 else f"<p>{prose(chr(2), 1)}</p>" for _ in range(rnd.randint(1, 4)))
        elif kind == "form":
            inner = f"<label>{junk()}</label><p>{junk()}</p>"
        else:
            inner = "".join(rnd.choice(["<p>{}</p>", "<div>{}</div>", "{}", "<h3>{}</h3><p>{}</p>"]).replace("{}", rnd.choice([junk(), prose("\x02", 2, 16)]), 1).replace("{}", junk()) for _ in range(rnd.randint(1, 3)))
        return f"<{tag}{attr}>{inner}</{tag}>"

    def article() -> str:
        parts = [f"<h1>{prose(chr(1), 2, 12)}</h1>"] if rnd.random() < 0.85 else []
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 8, 12])):
            kind = rnd.random()
            if kind < 0.68:
                parts.append(rnd.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}"]).replace("{}", prose("\x01", 1, 70)))
            elif kind < 0.76:
                parts.append(f"<h2>{prose(chr(1), 1, 8)}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{prose(chr(1), 1, 20)}</li>" for _ in range(rnd.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{prose(chr(1))}</p></blockquote>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{prose(chr(1), 1, 5)}</td><td>{prose(chr(1), 1, 5)}</td></tr>" for _ in range(rnd.randint(1, 3))) + "</table>")
            elif len(parts) > 1:
                parts.append(boiler(rnd.choice(["ad", "share", "aside", "form", "notice"])))
        body = "".join(parts) or f"<p>{prose(chr(1))}</p>"
        kind = rnd.random()
        if kind < 0.6:
            return f"<article{rnd.choice(['', '', ' class=' + chr(34) + rnd.choice(_GOOD_CLASSES) + chr(34)])}>{body}</article>"
        if kind < 0.75:
            return f"<main>{body}</main>"
        return f'<div class="{rnd.choice(_GOOD_CLASSES)}">{body}</div>'

    before = [boiler(k) for k in ("header", "nav", "notice", "ad", "share", "form") if rnd.random() < 0.45]
    after = [boiler(k) for k in ("share", "comments", "aside", "ad", "form", "notice", "footer") if rnd.random() < 0.4]
    rnd.shuffle(before)
    return f"<html><head><title>{words(3)}</title></head><body>{''.join(before)}{article()}{''.join(after)}</body></html>"


@lru_cache(2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller after Adam steps on pages of ``make_page``; some ten seconds on one core, once a session."""
    rnd = random.Random(seed)
    sets = []
    for _ in range(pages):
        found = [b for b in blocks(make_page(rnd)) if b.text[0] in "\x01\x02"]
        y = np.array([b.text[0] == "\x01" for b in found], np.float32)
        for b in found:
            b.text = b.text[1:] or "x"
        if found:
            sets.append((vectors(found), y))
    model, first, second, step = Labeller(seed), {}, {}, 0
    for epoch in range(epochs):
        sets.sort(key=lambda s: len(s[0]) + 3 * rnd.random())
        batches = [sets[i : i + BATCH] for i in range(0, len(sets), BATCH)]
        rnd.shuffle(batches)
        for batch in batches:
            step += 1
            x, live = stacked([v for v, _ in batch])
            y = np.zeros(live.shape, np.float32)
            for j, (_, own) in enumerate(batch):
                y[: len(own), j] = own
            for k, g in model.gradients(x, live, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                rate = 0.01 * (1 - 0.7 * epoch / epochs)
                model.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p or "") for p in pages]
    every, sizes = [b for f in found for b in f], [len(f) for f in found]
    total = np.repeat(sizes, sizes)
    place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    parts = [model.project(vectors(every[i : i + CHUNK], place[i : i + CHUNK], total[i : i + CHUNK])) for i in range(0, len(every), CHUNK)]
    z = np.concatenate(parts) if parts else np.zeros((0, 8 * model.hidden), np.float32)
    marks = model.label_projected(np.split(z, np.cumsum(sizes)[:-1]) if sizes else [])
    return ["\n\n".join(b.text for b, p in zip(f, m, strict=True) if p >= 0.5) for f, m in zip(found, marks, strict=True)]


def extract(pages: DataFrame, *, html: str = "html", keep_html: bool = False) -> DataFrame:
    """``pages`` with text and n_chars, and without the html unless it is to be kept."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())
    rest = [c for c in pages.columns if c not in ("text", "n_chars") and (keep_html or c != html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, html, SLICE_BYTES):
                text = main_texts(tx.column(part, html).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([*tx.pick(part, *rest), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [*rest, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "text string", "n_chars long"])
    return pages.select(*dict.fromkeys([*rest, html])).mapInArrow(run, schema)
