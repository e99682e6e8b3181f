"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks, runs of text between block-level tags, in page order.  Each block is described by a
hashed vector of its tag path (tags, classes and ids of all open elements), one of the innermost two elements, one of its
words, and a few counts.  A bidirectional LSTM in numpy reads the whole sequence, so each block is classified with the
page around it, and the blocks labelled as content are joined.

The model learns from at most ``TRAIN_PAGES`` pages, those with the smallest digests of their ids, by weak labels:
elements whose names or classes say what they are.  Each of these pages is also shown with containers renamed and with
notices, side bars, forms and reader comments put in, so the labels are learnt for markup that the sample lacks.

Edge cases: a null or empty page has an empty text; broken markup is read as browsers do, roughly: unclosed elements end
with their parent, stray end tags are dropped, an unclosed script or comment runs to the end; rows that repeat a
``page_id`` are separate rows; without pages there is no model and no row.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample.
TRAIN_PAGES = 400
EPOCHS = 6
HIDDEN = 20
PATH_BINS, NEAR_BINS, WORD_BINS, COUNTS = 192, 64, 48, 5
WIDTH = PATH_BINS + NEAR_BINS + WORD_BINS + COUNTS
#: Pages whose blocks are classified together.
PAGES = 128

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CUT = re.compile(r"[\s_-]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea svg math select object".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_STOPS = frozenset("ul ol dl table div section article main nav aside header footer form body".split())

# Weak labels: what names of elements, classes and ids say about their text.
_CONTENT = frozenset("article main content post story entry body".split())
_BESIDE = frozenset("""ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs button comment comments consent
cookie cookies dialog disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice
popup promo related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags title toolbar widget""".split())


_BESIDE_ELEMENTS = frozenset("aside dialog footer form header nav title".split())


@dataclass
class Leaves:
    """The leaf blocks of one page."""

    texts: list[str]
    paths: bytes
    near: bytes
    linked: list[float]
    labels: list[int]


def _tokens(tag: str, attributes: str) -> list[str]:
    out = [tag]
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            out += [f"{'r' if kind == 'role' else 'n'}.{part}" for part in _CUT.split(value) if part]
    return out


def _bin(token: str, bins: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % bins


def leaves(page: str) -> Leaves:
    """Cuts a page into leaf blocks; white space inside a block becomes one space."""
    out = Leaves([], b"", b"", [], [])
    paths, near = [], []
    stack: list[tuple[str, list[int], list[int], int, int]] = []  # tag, path bins, near bins, content, beside
    path = bytearray(PATH_BINS)
    content = beside = links = 0
    parts: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.texts.append(text)
            paths.append(bytes(path))
            own = bytearray(NEAR_BINS)
            for _, _, bins, _, _ in stack[-2:]:
                for b in bins:
                    own[b] = 1
            near.append(bytes(own))
            out.linked.append(min(1.0, linked / len(text)))
            out.labels.append(2 if beside else 1 if content else 0)
        parts, linked = [], 0

    def pop() -> None:
        nonlocal content, beside, links
        tag, bins, _, c, b = stack.pop()
        for k in bins:
            if path[k] < 255:
                path[k] -= 1
        content, beside, links = content - c, beside - b, links - (tag == "a")

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            piece = page[at:m.start() if m else end]
            parts.append(piece)
            linked += len(piece) if links else 0
            if m is None:
                break
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            if tag not in _INLINE:
                close_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
            continue
        if tag not in _INLINE:
            close_block()
        if tag in _RAW:
            if not attributes.endswith("/"):
                done = re.compile(rf"</{re.escape(tag)}(?![A-Za-z0-9])[^>]*+>?", re.I).search(page, at)
                at = done.end() if done else end
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P and any(s[0] == "p" for s in stack):
            while pop_until_p(stack, pop):
                pass
        if tag in _CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _CLOSES[tag]:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _STOPS:
                    break
        names = _tokens(tag, attributes)
        bins = [_bin(n, PATH_BINS) for n in names]
        for k in bins:
            if path[k] < 255:
                path[k] += 1
        said = {n.rpartition(".")[2] for n in names}
        inner = content > 0 and tag in ("header", "body")
        c, b = int(bool(said & _CONTENT) and tag != "body"), int(bool(said & _BESIDE) and not inner)
        stack.append((tag, bins, [_bin("near " + n, NEAR_BINS) for n in names], c, b))
        content, beside, links = content + c, beside + b, links + (tag == "a")
    close_block()
    out.paths, out.near = b"".join(paths), b"".join(near)
    return out


def pop_until_p(stack: list, pop) -> bool:
    """Pops one element towards an open paragraph; false once it is closed or another block lies on top of it."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == "p":
            pop()
            return len(stack) > k
        if stack[k][0] not in _INLINE:
            return False
    return False


def weak_labels(page: Leaves) -> np.ndarray:
    """1 for content.  Where no element claims to be content, blocks of running text outside other elements are."""
    labels = np.array(page.labels)
    if (labels == 1).any():
        return (labels == 1).astype(np.float32)
    long = np.array([len(t) >= 80 for t in page.texts]) & (np.array(page.linked) < 0.5)
    return ((labels == 0) & long).astype(np.float32)


_word_bins: dict[str, int] = {}


def _word_vector(text: str) -> np.ndarray:
    if len(_word_bins) > 200_000:
        _word_bins.clear()
    at = []
    for w in text.lower().split():
        b = _word_bins.get(w)
        if b is None:
            b = _word_bins[w] = _bin(w, WORD_BINS)
        at.append(b)
    counts = np.bincount(at, minlength=WORD_BINS).astype(np.float32)
    return counts / max(1, len(at))


def inputs(page: Leaves) -> np.ndarray:
    """One row of WIDTH numbers per block."""
    n = len(page.texts)
    x = np.zeros((n, WIDTH), np.float32)
    if not n:
        return x
    x[:, :PATH_BINS] = np.minimum(np.frombuffer(page.paths, np.uint8).reshape(n, -1), 2)
    x[:, PATH_BINS:PATH_BINS + NEAR_BINS] = np.frombuffer(page.near, np.uint8).reshape(n, -1)
    for i, t in enumerate(page.texts):
        x[i, PATH_BINS + NEAR_BINS:-COUNTS] = _word_vector(t)
    chars = np.array(list(map(len, page.texts)), np.float32)
    x[:, -5] = np.log1p(chars) / 8
    x[:, -4] = page.linked
    x[:, -3] = [t[-1] in ".!?…" for t in page.texts]
    x[:, -2] = np.arange(n) / n
    x[:, -1] = chars / chars.max()
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one from each end of the page, and a logistic unit on both states."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"out": scale(2 * HIDDEN, 1), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"{side}x": scale(WIDTH, 4 * HIDDEN), f"{side}h": scale(HIDDEN, 4 * HIDDEN), f"{side}b": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"{side}b"][HIDDEN:2 * HIDDEN] = 1

    @classmethod
    def load(cls, raw: bytes) -> Labeller:
        model, at = cls(), 0
        for k in sorted(model.p):
            n = model.p[k].size
            model.p[k] = np.frombuffer(raw, np.float32, n, at).reshape(model.p[k].shape)
            at += 4 * n
        return model

    def dump(self) -> bytes:
        return b"".join(self.p[k].astype(np.float32).tobytes() for k in sorted(self.p))

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction for padded sequences x (steps, pages, WIDTH)."""
        steps, pages = mask.shape
        gates = x @ self.p[f"{side}x"] + self.p[f"{side}b"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        states, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.p[f"{side}h"]
            ifo, g = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN:2 * HIDDEN], ifo[:, 2 * HIDDEN:]
            on = mask[t][:, None]
            fresh = f * c + i * g
            top = np.tanh(fresh)
            if keep:
                tape.append((t, h, c, i, f, o, g, top, on))
            c = np.where(on, fresh, c)
            h = np.where(on, o * top, h)
            states[t] = h
        return states, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(side, x, mask, False)[0] for side in "fb"], 2)
        return (both @ self.p["out"])[:, :, 0] + self.p["out_b"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {side: self._run(side, x, mask, True) for side in "fb"}
        both = np.concatenate([runs[side][0] for side in "fb"], 2)
        wrong = (_sigmoid((both @ self.p["out"])[:, :, 0] + self.p["out_b"]) - y) * mask / mask.sum()
        grad = {"out": np.einsum("tbh,tb->h", both, wrong)[:, None], "out_b": wrong.sum(keepdims=True)[0]}
        for k, side in enumerate("fb"):
            from_out = wrong[:, :, None] * self.p["out"][k * HIDDEN:(k + 1) * HIDDEN, 0]
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            grad[f"{side}h"] = np.zeros_like(self.p[f"{side}h"])
            dh = dc = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, top, on in reversed(runs[side][1]):
                dh = dh + from_out[t]
                live = np.where(on, dh, 0)
                into = np.where(on, dc, 0) + live * o * (1 - top * top)
                dz = np.concatenate([into * g * i * (1 - i), into * c * f * (1 - f), live * top * o * (1 - o), into * i * (1 - g * g)], 1)
                dz_all[t] = dz
                grad[f"{side}h"] += h.T @ dz
                dh = np.where(on, 0, dh) + dz @ self.p[f"{side}h"].T
                dc = np.where(on, into * f, dc)
            grad[f"{side}x"] = np.einsum("tbd,tbh->dh", x, dz_all, optimize=True)
            grad[f"{side}b"] = dz_all.sum(axis=(0, 1))
        return grad


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), WIDTH), np.float32), np.zeros((steps, len(rows)), bool)
    for k, r in enumerate(rows):
        x[:len(r), k], mask[:len(r), k] = r, True
    return x, mask


_ARTICLE = re.compile(r"<(/?)article\b[^>]*>", re.I)
_WRAPPERS = (("main", "main"), ('div class="post-content"', "div"), ('section id="story"', "section"), ('div class="entry"', "div"), ('div id="content"', "div"))
_BESIDES = (
    '<{t} {k}="{w}"><h3>{0}</h3><p>{1}</p></{t}>', '<{t} {k}="{w}"><div class="{w}"><p>{1}</p></div></{t}>', '<{t} {k}="{w}">{1}</{t}>',
    '<{t} {k}="main-{w}"><ul><li><a href="/">{0}</a></li><li>{1}</li></ul></{t}>', '<aside><p>{1}</p></aside>', '<aside>{0}</aside>',
    '<header><h2>{0}</h2><p>{1}</p></header>', '<form action="/"><p>{1}</p><label>{0}</label></form>', '<nav><a href="/">{0}</a> {1}</nav>', '<footer><p>{1}</p></footer>',
)
_BESIDE_TAGS = ("div", "section", "aside", "div", "p")


def _variants(page: str, rng: np.random.Generator) -> list[str]:
    """The page itself and the page with other containers and with blocks put in that are not content."""
    texts = leaves(page).texts or ["-"]

    def beside() -> str:
        words = sorted(_BESIDE - _BESIDE_ELEMENTS)
        return _BESIDES[rng.integers(len(_BESIDES))].format(
            *(entities.escape(texts[rng.integers(len(texts))]) for _ in range(2)),
            t=_BESIDE_TAGS[rng.integers(len(_BESIDE_TAGS))], k=("class", "id")[rng.integers(2)], w=words[rng.integers(len(words))])

    start, end = _WRAPPERS[rng.integers(len(_WRAPPERS))]
    renamed = _ARTICLE.sub(lambda m: f"{beside() if rng.random() < 0.5 else ''}</{end}>{beside()}" if m[1] else f"{beside()}<{start}>", page)
    filled = _ARTICLE.sub(lambda m: f"{beside()}</article>{beside()}" if m[1] else f"{beside()}<article>{beside() if rng.random() < 0.5 else ''}", page)
    more = re.sub(r"</p>(?=\s*<p)", lambda m: f"</p>{beside()}" if rng.random() < 0.3 else "</p>", page)
    return [page, renamed, filled, more]


def fit(pages: list[str], seed: int = 11) -> Labeller:
    """Trains on the pages and their variants with Adam."""
    rng = np.random.default_rng(seed)
    shown = [x for p in pages for x in map(leaves, _variants(p, rng)) if x.texts]
    data = [(inputs(x), weak_labels(x)) for x in shown]
    model = Labeller()
    first, second, count = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for _ in range(EPOCHS if data else 0):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][1]))
        groups = [order[a:a + 24] for a in range(0, len(order), 24)]
        for g in rng.permutation(len(groups)):
            some = [data[i] for i in groups[g]]
            x, mask = _padded([s[0] for s in some])
            y = np.zeros(mask.shape, np.float32)
            for k, s in enumerate(some):
                y[:len(s[1]), k] = s[1]
            count += 1
            for k, d in model.gradient(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                model.p[k] = model.p[k] - 0.01 * (first[k] / (1 - 0.9 ** count)) / (np.sqrt(second[k] / (1 - 0.99 ** count)) + 1e-8)
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """The content of each page; pages of like length are classified together."""
    cut = [leaves(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, c in enumerate(cut) if c.texts), key=lambda i: len(cut[i].texts))
    at = 0
    while at < len(order):
        to = at + 1  # padding stays below half, and a group below a few MB
        while to < len(order) and to - at < 64 and len(cut[order[to]].texts) <= 2 * len(cut[order[at]].texts) and (to - at) * len(cut[order[to]].texts) < 4096:
            to += 1
        some = order[at:to]
        x, mask = _padded([inputs(cut[i]) for i in some])
        kept = model.logits(x, mask) > 0
        for k, i in enumerate(some):
            out[i] = " ".join(t for t, keep in zip(cut[i].texts, kept[:, k], strict=False) if keep)
        at = to
    return out


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = sorted((p, t or "") for b in batches for p, t in zip(b.column("place").to_pylist(), b.column("html").to_pylist(), strict=True))
    if pages:
        yield pa.RecordBatch.from_arrays([pa.array([fit([t for _, t in pages]).dump()], pa.binary())], ["model"])


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> bytes | None:
    """The model from a bounded sample of pages, fitted in one task."""
    place = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    sample = pages.where("html is not null").select(place.alias("place"), F.col("html").cast("string").alias("html")).orderBy("place", "html").limit(rows)
    found = sample.repartition(1).mapInArrow(_fit_rows, "model binary").head()
    return bytes(found["model"]) if found else None


def _text_rows(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller.load(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                texts = main_texts(model, [p or "" for p in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, rows: int = TRAIN_PAGES) -> DataFrame:
    """Per page its main ``text`` and ``n_chars``; trains while it is called, then one narrow pass over the pages."""
    model = train(pages, rows) or Labeller().dump()
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(_text_rows(model), "page_id long, url string, text string, n_chars long")
