"""Operator 3: main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between block-level tags. Each block is read as a vector - the
tags, classes and ids on its path, and its words, both hashed, with its length and its share of link text - and
a bidirectional LSTM, whose states run over the whole page in both directions, says of every block whether it
belongs to the article.

No table labels blocks, so the network learns from pages that say it themselves: within ``article`` or ``main``,
outside of what is never article text there (menus, asides, forms and the like), is text; all else isn't. It
then labels every block of every page from tags, words and neighbours, with or without such elements.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_of

#: Hashed features of path and words, and other ones; states of each direction.
PATH, WORDS, OTHER, STATES = 64, 32, 4, 16
#: The network is fitted on at most so many pages (those with the least hashes of their ids).
SAMPLE = 400
#: Pages of more blocks don't teach (every page is labelled, whatever its size): what comes to the driver is bounded.
TEACH_BLOCKS = 1000
#: A block's path names its outermost elements, at most so many; nesting itself has no bound.
DEPTH = 256
#: Pages are labelled together up to so many blocks (padded).
TOGETHER = 4096

# Elements of the HTML standard by how they lay out text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = "script|style|noscript|template|textarea|title|svg|math|iframe|object|head|select|canvas|audio|video"
#: Those whose content is characters only, so that nothing but their end tag ends them; an unclosed one of the others ends at the next block.
RAW = frozenset("script style textarea title iframe".split())
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
INLINE = frozenset("a abbr b bdi bdo big cite code em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var del".split())
#: What marks a block as beside the article, for the pages that teach.
ASIDE = frozenset("nav aside footer form menu button dialog search".split())
BESIDE = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|banner|cookie\w*|consent|comments?|disqus|footer|menu|nav\w*|newsletter|notice|popup|promo\w*|related|share|sidebar|social|sponsor\w*|subscribe)(?:$|[^a-z])", re.I)
#: What the second reading of a teaching page does without.
STRUCTURE = ASIDE | {"article", "main", "header"}
WITHIN = re.compile(r"(?:^|[^a-z])(?:article\w*|body|content\w*|entry|header\w*|main\w*|post\w*|story|text)(?:$|[^a-z])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*+>?|<(" + SILENT + r")(?=[\s/>])[^>]*+(?<!/)>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</[^>]*+>", re.S | re.I)
_ENDING = {t: re.compile(rf"</{t}\s*+>|(?=<body[\s/>])", re.I) for t in SILENT.split("|")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def blocks(html: str) -> list[tuple[tuple[str, ...], str, float]]:
    """Leaf blocks in page order: path (tags, and classes, ids and roles after a dot), text, share of link text."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = at = 0
    opened: dict[str, int] = {}  # how many elements of each tag are open
    unclosed: set[str] = set()  # silent elements without an end further on
    hushed = False  # within an unclosed silent element

    def add(raw: str) -> None:
        nonlocal linked
        if hushed:
            return
        parts.append(raw)
        if links:
            linked += len(raw)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((tuple(x for _, names in stack[:DEPTH] for x in names), text, min(1.0, linked / max(1, len(text)))))
            parts.clear()
            linked = 0

    def place(tag: str) -> int:
        """Where the innermost open element of a tag is, or -1; an inline one isn't looked for beyond its block."""
        if opened.get(tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    return i
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break
        return -1

    def end(depth: int) -> None:
        for t, _ in stack[depth:]:
            opened[t] -= 1
        del stack[depth:]

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            ending = None if name in unclosed else _ENDING[name].search(html, at)
            if ending:
                at = ending.end()
                continue
            unclosed.add(name)
            if name in RAW:
                at = len(html)
            elif name != "head":  # what silences within a head does so itself; all else ends it
                hushed = True
            continue
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append("\n")
        elif m[2]:
            depth = place(tag)
            if hushed and (tag not in BLOCK or depth < 0):
                continue
            hushed = False
            if tag in BLOCK:
                close()
            if depth >= 0:
                end(depth)
            if tag == "a":
                links = 0
        else:
            if hushed and (tag not in BLOCK or tag in ("option", "optgroup")):
                continue
            hushed = False
            if tag in BLOCK:
                close()
                while stack and (stack[-1][0] in INLINE or tag in ENDS.get(stack[-1][0], ())):  # implied ends
                    if stack[-1][0] in INLINE and not any(tag in ENDS.get(t, ()) for t, _ in stack[-3:]):
                        break
                    end(len(stack) - 1)
                links = 0
            if tag not in VOID and not m[4].endswith("/"):
                if tag == "a":
                    links = 1
                names = [tag]
                if "=" in m[4] and len(stack) < DEPTH:
                    names += [f".{n.lower()}" for g in _NAMES.findall(m[4]) for n in "".join(g).split()]
                stack.append((tag, tuple(names)))
                opened[tag] = opened.get(tag, 0) + 1
    if at < len(html):
        add(html[at:])
    close()
    return out


def own_label(path: tuple[str, ...]) -> int | None:
    """1 or 0 where the page's own elements say whether a block is article text; None where it has no such element."""
    if "article" not in path and "main" not in path:
        return None
    inner = path[max(i for i, t in enumerate(path) if t in ("article", "main")) :]
    return int(not any(t in ASIDE or (t[0] == "." and BESIDE.search(t)) for t in inner))


def plain_path(path: tuple[str, ...]) -> tuple[str, ...]:
    """A path as a page without structural elements has it: they are plain ``div``s, and classes, ids and roles that tell are gone."""
    return tuple("div" if t in STRUCTURE else t for t in path if not (t[0] == "." and (BESIDE.search(t) or WITHIN.search(t))))


_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    got = _hashes.get(word)
    if got is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        got = _hashes[word] = xxhash.xxh3_64_intdigest(word)
    return got


def vectors(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """One row for each block."""
    x = np.zeros((len(page), PATH + WORDS + OTHER), np.float32)
    for i, (path, text, linked) in enumerate(page):
        for depth, name in enumerate(path):
            x[i, _hash(name) % (PATH // 2)] = 1
            if depth >= len(path) - 2:
                x[i, PATH // 2 + _hash(name) % (PATH // 2)] = 1
        words = text.split(" ")
        x[i, PATH : PATH + WORDS] = np.bincount([_hash(w) % WORDS for w in words], minlength=WORDS)
        x[i, PATH : PATH + WORDS] /= len(words) ** 0.5
        x[i, -4:] = np.log1p(len(words)) / 6, linked, text[-1] in ".!?…", i / len(page)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Labeller:
    """The network: for each direction input, recurrent and bias weights of the four gates; output weights over both."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        n = PATH + WORDS + OTHER
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"{d}x"] = rng.normal(0, n**-0.5, (n, 4 * STATES)).astype(np.float32)
            self.w[f"{d}h"] = rng.normal(0, STATES**-0.5, (STATES, 4 * STATES)).astype(np.float32)
            bias = np.zeros(4 * STATES, np.float32)
            bias[STATES : 2 * STATES] = 1  # forget little at first
            self.w[f"{d}b"] = bias
        self.w["o"], self.w["ob"] = rng.normal(0, 0.3, 2 * STATES).astype(np.float32), np.zeros(1, np.float32)

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray):
        """States over time for a batch (page, block, feature); padded steps carry the state on."""
        n, steps, _ = x.shape
        pre = x @ self.w[f"{d}x"] + self.w[f"{d}b"]
        h, c = np.zeros((n, STATES), np.float32), np.zeros((n, STATES), np.float32)
        out, kept = np.zeros((n, steps, STATES), np.float32), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w[f"{d}h"]
            i, f, o = (_sigmoid(z[:, k * STATES : (k + 1) * STATES]) for k in (0, 1, 2))
            g, m = np.tanh(z[:, 3 * STATES :]), mask[:, t, None]
            new = f * c + i * g
            tc = np.tanh(new)
            kept[t] = (i, f, o, g, c, tc, h)
            c, h = np.where(m, new, c), np.where(m, o * tc, h)
            out[:, t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray):
        f, kf = self._pass("f", x, mask)
        b, kb = self._pass("b", x, mask)
        both = np.concatenate([f, b], 2)
        return _sigmoid(both @ self.w["o"] + self.w["ob"][0]), both, kf, kb

    def _back(self, d: str, x: np.ndarray, mask: np.ndarray, dout: np.ndarray, kept: list, grads: dict) -> None:
        n, steps, _ = x.shape
        dh, dc = np.zeros((n, STATES), np.float32), np.zeros((n, STATES), np.float32)
        dz_all = np.zeros((n, steps, 4 * STATES), np.float32)
        wh = self.w[f"{d}h"]
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            i, f, o, g, c, tc, h = kept[t]
            m = mask[:, t, None]
            dh = dh + dout[:, t]
            live = np.where(m, dh, 0)
            dnew = live * o * (1 - tc * tc) + np.where(m, dc, 0)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tc * o * (1 - o), dnew * i * (1 - g * g)], 1)
            dz_all[:, t] = dz
            grads[f"{d}h"] += h.T @ dz
            dh, dc = np.where(m, dz @ wh.T, dh), np.where(m, dnew * f, dc)
        flat = dz_all.reshape(-1, 4 * STATES)
        grads[f"{d}x"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[f"{d}b"] += flat.sum(0)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 16, rate: float = 0.02, seed: int = 6) -> Labeller:
        """Adam over pages of (vectors, labels); a label below 0 teaches nothing."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                chosen = [pages[k] for k in order[at : at + batch]]
                x, mask = pad([p for p, _ in chosen])
                y = np.full(mask.shape, -1, np.float32)
                for k, (_, labels) in enumerate(chosen):
                    y[k, : len(labels)] = labels
                p, both, kf, kb = self.forward(x, mask)
                d = np.where(y >= 0, p - y, 0).astype(np.float32) / max(1, (y >= 0).sum())
                grads = {k: np.zeros_like(v) for k, v in self.w.items()}
                grads["o"], grads["ob"] = np.einsum("nt,nth->h", d, both), d.sum(keepdims=True).reshape(1)
                dout = d[:, :, None] * self.w["o"]
                self._back("f", x, mask, dout[:, :, :STATES], kf, grads)
                self._back("b", x, mask, dout[:, :, STATES:], kb, grads)
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (1 - 0.8 * epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is article text. Pages of like length go together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= TOGETHER:
                end += 1
            chosen = order[at:end]
            x, mask = pad([pages[i] for i in chosen])
            p = self.forward(x, mask)[0]
            for k, i in enumerate(chosen):
                out[i] = p[k, : len(pages[i])] >= 0.5
            at = end
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, PATH + WORDS + OTHER), np.float32), np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


def train(pages: DataFrame, sample: int = SAMPLE, key: str = "page_id") -> Labeller:
    """Fits the network on at most ``sample`` pages of at most ``TEACH_BLOCKS`` blocks that label themselves; their vectors are made on the executors.

    A third of them is read a second time without its structural names (article, main, nav and so on), so that
    words, shape and neighbours are learned from too. Without any such page nothing is known, and the labeller
    takes blocks as text that stand in no element of ``ASIDE``, by the same means.
    """
    chosen = pages.select(F.col(key).alias("k"), text_of("html").alias("html")).where(F.lower("html").rlike("<(article|main)[\\s>]"))
    chosen = chosen.select("k").orderBy(F.xxhash64("k"), "k").limit(sample).distinct().join(chosen, "k")

    def features(batches):
        for batch in batches:
            for k, html in zip(batch.column("k").to_pylist(), batch.column("html").to_pylist()):
                page = blocks(html)
                if len(page) > TEACH_BLOCKS:
                    continue
                y = np.array([-1 if (v := own_label(p)) is None else v for p, _, _ in page], np.float32)
                if not (y > 0).any():
                    continue
                y[y < 0] = 0  # on a page with an article, what stands outside it isn't text
                h = xxhash.xxh3_64_intdigest(html) >> 1
                readings = [page] if h % 3 else [page, [(plain_path(p), t, share) for p, t, share in page]]
                for x in map(vectors, readings):
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "h": [h], "x": [x.tobytes()], "y": [y.tobytes()]})

    found = sorted((r["h"], bytes(r["x"]), bytes(r["y"])) for r in chosen.mapInArrow(features, "k long, h long, x binary, y binary").collect())
    data = [(np.frombuffer(x, np.float32).reshape(-1, PATH + WORDS + OTHER), np.frombuffer(y, np.float32)) for _, x, y in found]
    if not data:
        data = [(vectors(p), np.array([0 if set(path) & ASIDE else 1 for path, _, _ in p], np.float32)) for p in [[((t, "p"), "a few words of text.", 0.0) for t in (*sorted(ASIDE), "div", "section", "body")]] * 32]
    return Labeller().fit(data)


def extract_text(pages: DataFrame, labeller: Labeller | None = None, key: str = "page_id", sample: int = SAMPLE) -> DataFrame:
    """Main text of every page: its article blocks in page order, joined by a newline.

    Returns key, url, text (empty if no block is article text) and n_chars. In a block character references are
    decoded, white space becomes one space and the ends are trimmed. Null or empty html has no blocks. Markup
    that is cut off or never closed is read as far as it goes. Repeated rows each get a row; other columns are
    ignored; an empty table gives an empty result.
    """
    labeller = train(pages, sample, key) if labeller is None else labeller
    rows = pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                found = [blocks(h) for h in part.column("html").to_pylist()]
                kept = labeller.label([vectors(p) for p in found])
                texts = ["\n".join(b[1] for b, k in zip(p, keep) if k) for p, keep in zip(found, kept)]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"{key} long, url string, text string, n_chars long")
