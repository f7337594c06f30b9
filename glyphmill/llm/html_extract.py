"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags. A block is seen as the sum of hashed vectors of
the tags, classes and ids on its path, the mean of hashed vectors of its words, and a few numbers (length, links, marks,
place). A bidirectional LSTM in numpy reads a page's whole sequence of blocks and labels each as main text or not.

There are no labels to learn from, so training pages are made: the text of at most ``SAMPLE`` pages (those of the
smallest hashes of their ids) is dealt into layouts drawn at random, whose menus, headers, sidebars, notices, adverts,
forms and comments are known; and the pages themselves are labelled where their tags say plainly what a block is. Words
are the same inside and outside the main text, so only layout and context are learned. Every page is labelled.

Defined results: a null page is empty; a page without blocks has an empty text. Scripts, styles, head, comments and the
fields of forms (textarea, select, option) give no blocks. What stands in for pictures, formulas, sounds and scripts (svg,
math, object, canvas, audio, video, iframe, noscript, template) is read as the text it holds. Unclosed and stray tags are
borne as browsers do, roughly: a new paragraph ends the one before, an end tag without a start is left out. A head without an
end tag ends at the first tag that a head can't hold, an option at the next option or at the end or start of what is around
it; of the other unseen elements only those of raw text (script, style, title, textarea) reach to the page's end without one.
Rows that repeat are labelled alike; a row without an id is labelled, but never learned from. White space, no-break spaces
included, becomes one space. A page of any length is labelled in one run; from BATCH_BLOCKS blocks on, its numbers are made a
part at a time, for either direction, while the network's state is carried on. Time and memory follow the length of a page,
however deep its elements are nested. An empty table gives an empty table; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import free_name, text_or_empty

#: Pages to fit on, at most.
SAMPLE = 300
#: Hashed vectors of path parts and of words with their lengths, numbers of a block, and cells of either direction.
PATHS, PATH_DIM, WORDS, WORD_DIM, NUMBERS, CELLS = 4096, 24, 8192, 8, 7, 24
#: Blocks in a batch of pages that is labelled at once.
BATCH_BLOCKS = 20_000

INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data dfn em font i iframe img ins kbd label mark math noscript object q s samp small span strike strong sub sup svg template time tt u var video wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style head title textarea select option".split())
MAIN_TAGS = frozenset(["article", "main"])
#: An open element of the first set is ended by the start of one of the second.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)[^>]*>?""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[A-Za-z]+")
END_OF = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in UNSEEN}
#: Unseen elements whose text is no markup: without an end tag they reach to the page's end.
RAW = frozenset("script style title textarea".split())
#: What a head can hold; any other tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Tags that end an option, besides end tags other than its own inline ones'.
AFTER_OPTION = frozenset("option optgroup select datalist".split())


def unseen_end(html: str, at: int, tag: str, endless: set[str]) -> int:
    """Where the unseen element ends whose start tag ends at ``at``. Without an end tag, an element that isn't raw text is only its start tag.

    ``endless`` remembers of which tags no end follows, so the page is searched for them once.
    """
    if tag not in ("head", "option"):
        end = None if tag in endless else END_OF[tag].search(html, at)
        if end is None:
            endless.add(tag)
        return end.end() if end else len(html) if tag in RAW else at
    while (m := TAG.search(html, at)) is not None:
        name = (m[2] or "").lower()
        if tag == "head" and html[at : m.start()].strip():  # text ends a head, too
            return at
        if m[1] and name == tag:
            return m.end()
        if not name or (tag == "head" and m[1] and name not in ("body", "html", "br")):
            at = m.end()
        elif tag == "head" and name not in IN_HEAD or tag == "option" and (name in AFTER_OPTION or name not in INLINE and name not in UNSEEN):
            return m.start()
        else:
            at = unseen_end(html, m.end(), name, endless) if not m[1] and name in UNSEEN and not m[3].rstrip().endswith("/") else m.end()
    return len(html) if tag == "option" else at


class Path:
    """An element's place in a page: its tag with its class, id and role, and the place it is in.

    Places share what they have in common: ``rows``, those of the vectors of all tags and names on the path, are the
    ones of the place around where nothing is added, so deep nesting costs no more than its new names.
    """

    __slots__ = ("around", "item", "labels", "last", "main", "rows")

    def __init__(self, around: Path | None, item: str):
        tag, _, names = item.partition(" ")
        own = {f"<{tag}"}
        for w in PART.findall(names):
            own |= {"." + w.lower(), "." + w.lower()[:5] + "*"}
        new = frozenset(zlib.crc32(r.encode()) % PATHS for r in own)
        before = around.rows if around else frozenset()
        self.around, self.item = around, item
        self.rows = before if new <= before else before | new
        self.last = tag if tag not in INLINE else around.last if around else ""
        self.main = tag in MAIN_TAGS or bool(around and around.main)
        self.labels: dict[bool, int | None] = {}


@dataclass
class Block:
    text: str
    path: Path | None
    linked: int  # characters inside links


def blocks(html: str) -> list[Block]:
    """The blocks of a page in their order."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    solid: list[int] = []  # places in the stack of the elements that aren't inline
    opened: dict[str, int] = {}
    endless: set[str] = set()
    text: list[str] = []
    linked = [0]
    path: list[Path | None] = [None]

    def add(raw: str) -> None:
        if raw:
            if not text and not raw.isspace():
                path[0] = stack[-1][1] if stack else None
            if text or not raw.isspace():
                text.append(raw)
                if opened.get("a"):
                    linked[0] += len(raw)

    def flush() -> None:
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, path[0], linked[0]))
            text.clear()
        linked[0] = 0

    def close(k: int) -> None:
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]
        while solid and solid[-1] >= k:
            solid.pop()

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in UNSEEN:
            flush()
            if not m[3].rstrip().endswith("/"):
                at = unseen_end(html, at, tag, endless)
            continue
        if tag not in INLINE:
            flush()
            # what this tag ends, looking through inline elements only
            if solid and tag in ENDED_BY.get(stack[solid[-1]][0], ()):
                close(solid[-1])
        if tag not in VOID and not m[3].endswith("/"):
            names = " ".join(x.strip("\"'") for x in NAMED.findall(m[3])) if m[3] else ""
            if tag not in INLINE:
                solid.append(len(stack))
            stack.append((tag, Path(stack[-1][1] if stack else None, f"{tag} {names}" if names else tag)))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def path_rows(path: Path | None) -> list[int]:
    """Rows of the path's vectors: its tags, the words of their classes, ids and roles and how these begin, and its last tag."""
    last = zlib.crc32(b"/" + (path.last if path else "").encode()) % PATHS
    return sorted((path.rows if path else frozenset()) | {last})


class Reader:
    """Blocks as numbers; remembers paths and words."""

    def __init__(self) -> None:
        self.paths: dict[tuple, list[int]] = {}
        self.words: dict[str, int] = {}

    def read(self, page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        paths, words = [], []
        numbers = np.zeros((len(page), NUMBERS))
        if len(self.paths) > 50_000:
            self.paths.clear()
        if len(self.words) > 200_000:
            self.words.clear()
        known = self.words
        for k, b in enumerate(page):
            place = (b.path.rows, b.path.last) if b.path else None
            if (p := self.paths.get(place)) is None:
                p = self.paths[place] = path_rows(b.path)
            paths.append(p)
            own = b.text.split(" ")
            ids = list(map(known.get, own))
            if None in ids:
                for j, i in enumerate(ids):
                    if i is None:
                        ids[j] = known[own[j]] = zlib.crc32(own[j].encode()) % WORDS
            words.append(ids)
            size = len(b.text)
            numbers[k] = (1, np.log1p(size) / 5, np.log1p(len(own)) / 3, min(1, b.linked / size), min(3, b.text.count(",") / len(own) * 5), b.text[-1] in ".!?\"", k / len(page))
        return paths, words, numbers


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    """A bidirectional LSTM over block vectors. ``p``: its arrays by name."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + NUMBERS
        self.p = {"path": rng.normal(0, 0.1, (PATHS, PATH_DIM)), "word": rng.normal(0, 0.02, (WORDS, WORD_DIM)), "v": rng.normal(0, 0.1, 2 * CELLS + size), "c": np.zeros(1)}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 1 / np.sqrt(size + CELLS), (size + CELLS, 4 * CELLS))
            self.p["z" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], CELLS)

    @staticmethod
    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lists])
        return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=sizes.sum()), sizes

    def vectors(self, paths: list[list[int]], words: list[list[int]], numbers: np.ndarray) -> tuple[np.ndarray, tuple]:
        pi, pn = self.flat(paths)
        wi, wn = self.flat(words)
        x = np.empty((len(numbers), PATH_DIM + WORD_DIM + NUMBERS))
        x[:, :PATH_DIM] = np.add.reduceat(self.p["path"][pi], np.cumsum(pn) - pn)
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.add.reduceat(self.p["word"][wi], np.cumsum(wn) - wn) / wn[:, None]
        x[:, -NUMBERS:] = numbers
        return x, (pi, pn, wi, wn)

    def run(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of the blocks of pages, laid end to end in ``x``; with ``keep`` what training needs."""
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        steps = int(lengths.max())
        live = np.searchsorted(-lengths[order], -np.arange(steps), side="left")
        out, kept = [], []
        for d in "fb":
            h = np.zeros((len(lengths), CELLS))
            c = np.zeros((len(lengths), CELLS))
            w, z = self.p["w" + d], self.p["z" + d]
            xw = x @ w[: x.shape[1]] + z
            hs = np.empty((len(x), CELLS))
            trace = []
            for t in range(steps):
                m = live[t]
                o = order[:m]
                rows = starts[o] + (t if d == "f" else lengths[o] - 1 - t)
                g = xw[rows] + h[:m] @ w[x.shape[1] :]
                gates = _sigmoid(g)
                new = np.tanh(g[:, 2 * CELLS : 3 * CELLS])
                i, f, q = gates[:, :CELLS], gates[:, CELLS : 2 * CELLS], gates[:, 3 * CELLS :]
                cell = f * c[:m] + i * new
                tc = np.tanh(cell)
                if keep:
                    trace.append((rows, h[:m].copy(), c[:m].copy(), i, f, new, q, tc))
                c[:m] = cell
                h[:m] = q * tc
                hs[rows] = h[:m]
            out.append(hs)
            kept.append(trace)
        whole = np.concatenate([*out, x], axis=1)
        return whole @ self.p["v"] + self.p["c"][0], whole, kept

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        logits, whole, kept = self.run(x, lengths, keep=True)
        g = (_sigmoid(logits) - y) * weight
        grads = {"v": whole.T @ g, "c": np.array([g.sum()])}
        gw = g[:, None] * self.p["v"]
        gx = gw[:, 2 * CELLS :].copy()
        for k, d in enumerate("fb"):
            w = self.p["w" + d]
            gh_out = gw[:, k * CELLS : (k + 1) * CELLS]
            dw, dz = np.zeros_like(w), np.zeros(4 * CELLS)
            gh = np.zeros((len(lengths), CELLS))
            gc = np.zeros((len(lengths), CELLS))
            for rows, h, c, i, f, new, q, tc in reversed(kept[k]):
                m = len(rows)
                dh = gh_out[rows] + gh[:m]
                dc = dh * q * (1 - tc**2) + gc[:m]
                dg = np.concatenate([dc * new * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - new**2), dh * tc * q * (1 - q)], axis=1)
                dw[: x.shape[1]] += x[rows].T @ dg
                dw[x.shape[1] :] += h.T @ dg
                dz += dg.sum(0)
                gx[rows] += dg @ w[: x.shape[1]].T
                gh[:m] = dg @ w[x.shape[1] :].T
                gc[:m] = dc * f
            grads["w" + d], grads["z" + d] = dw, dz
        return grads, gx

    def fit(self, pages: list[tuple], labels: list[np.ndarray], epochs: int = 16, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), 32):
                batch = [pages[i] for i in order[lo : lo + 32]]
                y = np.concatenate([labels[i] for i in order[lo : lo + 32]])
                lengths = np.array([len(b[2]) for b in batch])
                x, (pi, pn, wi, wn) = self.vectors([p for b in batch for p in b[0]], [w for b in batch for w in b[1]], np.concatenate([b[2] for b in batch]))
                grads, gx = self.gradients(x, lengths, y, np.full(len(y), 1 / len(y)))
                grads["path"] = np.zeros_like(self.p["path"])
                np.add.at(grads["path"], pi, np.repeat(gx[:, :PATH_DIM], pn, axis=0))
                grads["word"] = np.zeros_like(self.p["word"])
                np.add.at(grads["word"], wi, np.repeat(gx[:, PATH_DIM : PATH_DIM + WORD_DIM] / wn[:, None], wn, axis=0))
                step += 1
                rate = 0.01 * (1 - epoch / epochs)
                for k, gk in grads.items():
                    first[k] += 0.1 * (gk - first[k])
                    second[k] += 0.001 * (gk**2 - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def long(self, page: tuple, part: int) -> np.ndarray:
        """Logits of one page's blocks; vectors are made for ``part`` blocks at a time and no state is kept but the last."""
        paths, words, numbers = page
        n = len(numbers)
        logits = np.full(n, self.p["c"][0])
        size = PATH_DIM + WORD_DIM + NUMBERS
        v = self.p["v"]
        for k, d in enumerate("fb"):
            h, c = np.zeros(CELLS), np.zeros(CELLS)
            w, z = self.p["w" + d], self.p["z" + d]
            starts = range(0, n, part)
            for lo in starts if d == "f" else reversed(starts):
                hi = min(lo + part, n)
                x, _ = self.vectors(paths[lo:hi], words[lo:hi], numbers[lo:hi])
                if d == "f":
                    logits[lo:hi] += x @ v[2 * CELLS :]
                xw = x @ w[:size] + z
                out = np.empty((hi - lo, CELLS))
                for t in range(hi - lo) if d == "f" else range(hi - lo - 1, -1, -1):
                    g = xw[t] + h @ w[size:]
                    gates = _sigmoid(g)
                    c = gates[CELLS : 2 * CELLS] * c + gates[:CELLS] * np.tanh(g[2 * CELLS : 3 * CELLS])
                    h = out[t] = gates[3 * CELLS :] * np.tanh(c)
                logits[lo:hi] += out @ v[k * CELLS : (k + 1) * CELLS]
        return logits

    def label(self, pages: list[tuple], most: int = BATCH_BLOCKS) -> list[np.ndarray]:
        """Whether each block is main text."""
        got: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        for k, p in enumerate(pages):
            if len(p[2]) > most:
                got[k] = self.long(p, most) > 0
        todo = [k for k, p in enumerate(pages) if 0 < len(p[2]) <= most]
        todo.sort(key=lambda k: len(pages[k][2]))
        at = 0
        while at < len(todo):
            batch, n = [], 0
            while at < len(todo) and (not batch or n + len(pages[todo[at]][2]) <= most):
                batch.append(todo[at])
                n += len(pages[todo[at]][2])
                at += 1
            x, _ = self.vectors([p for k in batch for p in pages[k][0]], [w for k in batch for w in pages[k][1]], np.concatenate([pages[k][2] for k in batch]))
            lengths = np.array([len(pages[k][2]) for k in batch])
            main = self.run(x, lengths)[0] > 0
            for k, part in zip(batch, np.split(main, np.cumsum(lengths)[:-1]), strict=True):
                got[k] = part
        return got


#: Elements, and words of classes, ids and roles, that say plainly that a block is not main text.
AROUND_TAGS = frozenset("nav header footer aside form button menu dialog address".split())
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond "
    "disqus cookie cookies consent notice notices alert warning popup modal overlay newsletter subscribe signup login search share sharing social related recommended trending toolbar pagination pager copyright legal disclaimer toc skip contentinfo complementary".split()
)
def plain_label(b: Block) -> int | None:
    """1 and 0 where the path says it plainly, else None. What is nearer to the block counts more."""
    inside = bool(b.path and b.path.main)  # a header inside the main text has its title
    place, passed, label = b.path, [], None
    while place:
        if inside in place.labels:
            label = place.labels[inside]
            break
        passed.append(place)
        tag, _, names = place.item.partition(" ")
        if not (tag == "header" and inside):
            if tag in AROUND_TAGS or any(w.lower() in AROUND_WORDS for w in PART.findall(names)):
                label = 0
                break
            if tag in MAIN_TAGS:
                label = 1
                break
        place = place.around
    for place in passed:
        place.labels[inside] = label
    return label


def made_page(rng: np.random.Generator, texts: list[str]) -> tuple[str, list[int]]:
    """A page of a layout drawn at random around ``texts``, and its blocks' labels."""
    html, labels = ["<!DOCTYPE html><html><head><title>x</title></head><body>"], []
    say = lambda: texts[rng.integers(len(texts))]

    def words(n: int) -> str:
        own = say().split(" ")
        at = rng.integers(max(1, len(own) - n))
        return " ".join(own[at : at + n]) or "x"

    def put(before: str, text: str, after: str, label: int) -> None:
        html.append(f"{before}{text.replace('&', '&amp;').replace('<', '&lt;')}{after}")
        labels.append(label)

    def around(tag: str, name: str = "") -> None:
        html.append(f'<{tag} {rng.choice(["class", "id"])}="{name}">' if name else f"<{tag}>")
        kind = rng.integers(4)
        if kind == 0:
            html.append("<ul>")
            for _ in range(rng.integers(1, 9)):
                put('<li><a href="/x">', words(rng.integers(1, 4)), "</a></li>" if rng.random() < 0.8 else "</a>", 0)
            html.append("</ul>")
        elif kind == 1:
            for _ in range(rng.integers(1, 4)):
                put("<p>", words(rng.integers(3, 60)), "</p>", 0)
        elif kind == 2:
            put(f"<h{rng.integers(2, 5)}>", words(rng.integers(1, 6)), "</h3>", 0)
            put("<p>", words(rng.integers(5, 40)), "</p>", 0)
        else:
            put("" if rng.random() < 0.5 else "&copy; ", words(rng.integers(2, 30)), "", 0)
        html.append(f"</{tag}>")

    def any_around(inside: bool = False) -> None:
        if rng.random() < 0.45:
            around(str(rng.choice(sorted(AROUND_TAGS - {"header"} if inside else AROUND_TAGS))))
        else:
            name = str(rng.choice(sorted(AROUND_WORDS)))
            if rng.random() < 0.4:
                name = f"{rng.choice(['site', 'page', 'top', 'main', 'box', 'inner', 'block'])}-{name}"
            elif rng.random() < 0.4:
                name += str(rng.choice(["list", "box", "bar", "area", "wrap", "_inner", "-1", "Section"]))
            around(str(rng.choice(["div", "div", "section", "aside"])), name)

    for _ in range(rng.integers(0, 4)):
        any_around()
    kind = rng.integers(6)
    opened, closed = [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div id="content">', "</div>"), ('<div class="post-body entry article">', "</div>"), ("<div>", "</div>")][kind]
    html.append(opened)
    if rng.random() < 0.8:
        headed = rng.random() < 0.25  # an article's own header has its title
        put("<header><h1>" if headed else "<h1>", words(rng.integers(1, 12)), "</h1></header>" if headed else "</h1>", 1)
    for _ in range(rng.integers(1, 14)):
        r = rng.random()
        if r < 0.05:
            any_around(True)
        elif r < 0.2:
            put(f"<h{rng.integers(2, 5)}>", words(rng.integers(1, 8)), "</h2>", 1)
        elif r < 0.3:
            put("<blockquote>" if rng.random() < 0.3 else "<ul><li>", words(rng.integers(2, 40)), "</li></ul>", 1)
        elif r < 0.4:
            put("<p><b>", words(rng.integers(1, 25)), "<br>", 1)
        elif r < 0.45:
            put('<p>See <a href="/x">', words(rng.integers(1, 6)), "</a></p>", 1)
        else:
            put("<p>", say() if rng.random() < 0.5 else words(rng.integers(1, 120 if rng.random() < 0.7 else 4)), "</p>", 1)
    if rng.random() < 0.3:
        around("section" if rng.random() < 0.5 else "div", str(rng.choice(["comments", "comment", "replies", "related", "share"])))
    html.append(closed)
    for _ in range(rng.integers(0, 4)):
        any_around()
    if rng.random() < 0.8:
        html.append("</body></html>")
    return "".join(html), labels


def train(pages: list[str], made: int = 500, seed: int = 17) -> Labeller | None:
    """Fit on pages and pages made of their texts. None if the pages hold no text."""
    rng = np.random.default_rng(seed)
    reader, data, labels, texts = Reader(), [], [], []
    for html in pages:
        own = blocks(html)
        said = [plain_label(b) for b in own]
        texts += [b.text for b, y in zip(own, said, strict=True) if y == 1][:20]
        if own and None not in said:
            data.append(reader.read(own))
            labels.append(np.array(said, dtype=float))
        elif own:
            texts += [b.text for b in own if len(b.text) > 80][:20]
    if not texts:
        texts = ["a text of some words, as any page may hold it, to learn layouts by."]
    for _ in range(made):
        html, said = made_page(rng, texts)
        own = blocks(html)
        if own and len(own) == len(said):
            data.append(reader.read(own))
            labels.append(np.array(said, dtype=float))
    model = Labeller()
    model.fit(data, labels)
    return model


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """Train on ``sample`` pages at most, whatever the size of the table. Ids are chosen first, then their pages read."""
    ids = pages.select(F.col(id_col).alias("id")).where(F.col(id_col).isNotNull()).distinct()
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = pages.select(F.col(id_col).alias("id"), text_or_empty(html_col).alias("html")).join(F.broadcast(chosen), "id")
    got = rows.groupBy("id").agg(F.max("html").alias("html")).collect()  # of one id, one page
    return train([r["html"] for r in sorted(got, key=lambda r: r["id"])])


def extract(pages: DataFrame, model: Labeller, keep: list[str], html_col: str = "html", name: str = "text") -> DataFrame:
    """The columns ``keep`` of ``pages`` and ``name``, the main text; no shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{name}` string"
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                rows = batch.slice(at, 400)
                own = [blocks(h) for h in rows.column(len(keep)).to_pylist()]
                main = shared.value.label([reader.read(b) for b in own])
                texts = [" ".join(b.text for b, m in zip(page, said, strict=True) if m) for page, said in zip(own, main, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string())], names=[*keep, name])

    return pages.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(html_col).alias(free_name(pages, "html_read"))).mapInArrow(run, schema)
