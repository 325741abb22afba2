"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf sequences: stretches of text between block-level tags, each with the path
of its ancestors. A bidirectional LSTM, written in numpy, reads for every block a vector of its hashed
tag path (with class and id words), a vector of its hashed words and a few measures, over the whole page
in both directions, and decides for each block whether it belongs to the main text. The text of the
chosen blocks is joined in page order.

The network is trained here on at most ``TRAIN_PAGES`` pages. Its targets come from page structure:
inside an article or main element and outside menus, headers, footers, sidebars, notices, adverts,
forms and comments; on pages without such an element, long blocks with few links. On a part of the
training pages the telling tags and classes are hidden, so that the network learns from words and from
the surrounding blocks too.

Defined results: a null or empty page has the empty text; scripts, styles, comments and other markup
are never text; a page cut off inside a tag loses only that tag; repeated rows get equal texts. An
input column named like an added one is replaced.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.llm.common import without

TRAIN_PAGES = 400
PATH_DIMS, WORD_DIMS, HIDDEN = 48, 32, 16
#: Pages labelled together; sorted by length, so that padding stays small.
GROUP = 128

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
HIDDEN_TEXT = frozenset("script style title noscript noframes noembed iframe textarea template svg object".split())
#: Of these, the ones whose content is no markup: they end at their own end tag only.
RAW_TEXT = HIDDEN_TEXT - {"template", "svg", "object"}
#: What a head may hold; anything else ends it, as its end tag is optional.
HEAD_TAGS = frozenset("html base basefont bgsound link meta title noscript noframes style script template".split())
# Optional end tags: what a start tag closes, up to the next boundary.
_ROW = ("tr", "td", "th", "caption", "colgroup")
_GROUP = (*_ROW, "thead", "tbody", "tfoot")
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": _ROW, "thead": _GROUP, "tbody": _GROUP, "tfoot": _GROUP,
                 "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
                 "rt": ("rt", "rp"), "rp": ("rt", "rp")}
CLOSES_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                     "h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
BOUNDARIES = frozenset("ul ol dl table select body article section div td th button caption".split()) | HIDDEN_TEXT
# Where text is not main text, by element and by class or id.
ASIDE_TAGS = frozenset("nav header footer aside form button select dialog menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb "
    "breadcrumbs header footer sidebar side aside cookie cookies consent notice alert popup modal comment comments "
    "reply replies discussion share sharing social related recommended subscribe newsletter signup login form search "
    "widget pagination pager toolbar copyright legal disclaimer".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content post entry story body text".split())

# A quote opens a value only behind an equals sign.
_PAIR = r"([^\s/<>][^\s/<>=]*+)(?:\s*+=(?:\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>][^\s<>]*+)))?+)?+"
_PAIRS = re.compile(_PAIR)
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/<>]*+(?:[\s/]++|{_PAIR})*+(?:>|\Z|(?=<))|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_NONE = re.compile(r"none\s*(?:!\s*important\s*)?", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT}
_SCRIPT_PART = re.compile(r"<!--(?:-?>)?|-->|</?script(?=[\s/>])", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int = 0


@dataclass
class _Cutter:
    """Walks over the tokens of a page with the stack of open elements."""

    #: Name, class and id words, whether it or an ancestor is hidden.
    stack: list[tuple[str, tuple[str, ...], bool]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                path = tuple(w for name, words, _ in self.stack for w in (name, *words))
                self.blocks.append(Block(text, path, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    @property
    def hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def leave_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self.close("head")

    def text(self, raw: str) -> None:
        if raw.strip(" \t\n\f\r"):
            self.leave_head()
        if self.hidden:
            return
        self.parts.append(raw)
        if any(name == "a" for name, _, _ in self.stack):
            self.linked += len(raw.strip())

    def open(self, name: str, words: tuple[str, ...], unseen: bool = False) -> None:
        if name not in HEAD_TAGS:
            self.leave_head()
        if name == "br" and not self.hidden:
            self.parts.append(" ")
        if name not in INLINE:
            self.flush()
        closes, closes_p = CLOSES_ITSELF.get(name, ()), name in CLOSES_P
        for i in range(len(self.stack) - 1, -1, -1):
            above = self.stack[i][0]
            if above in closes or closes_p and above == "p":
                del self.stack[i:]
            elif above in BOUNDARIES:
                break
        if name not in VOID:
            self.stack.append((name, words, unseen or self.hidden))

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                del self.stack[i:]
                return
            if self.stack[i][0] in ("template", "object"):
                return


def cut_page(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with decoded text and ancestor path."""
    cutter, at = _Cutter(), 0
    if not page:
        return []
    while at < len(page):
        token = _TOKEN.match(page, at)
        raw, at = token[0], token.end()
        if raw[0] != "<" or raw == "<":
            cutter.text(raw)
            continue
        name = _NAME.match(raw)
        if not name or not raw.endswith(">"):
            continue
        tag = name[1].lower()
        if raw[1] == "/":
            cutter.close(tag)
        elif tag in HIDDEN_TEXT:
            cutter.flush()
            if tag not in HEAD_TAGS:
                cutter.leave_head()
            if _empty(raw, name.end()):
                continue
            if tag in RAW_TEXT:
                at = _raw_end(page, at, tag)
            else:
                cutter.stack.append((tag, (), True))
        elif cutter.hidden and _empty(raw, name.end()):
            continue
        else:
            unseen = tag not in VOID and bool(_MAY_HIDE.search(raw)) and _unseen(raw, name.end())
            if not (unseen and _empty(raw, name.end())):
                cutter.open(tag, _words(raw) if len(raw) > len(tag) + 2 else (), unseen)
    cutter.flush()
    return cutter.blocks


def _raw_end(page: str, at: int, name: str) -> int:
    """Where the end tag of a raw element starts whose content starts at ``at``; else the end of the page."""
    plain = _RAW_END[name].search(page, at)
    if plain and name == "script" and page.find("<!--", at, plain.start()) >= 0:
        # Inside a comment-like part of a script, a nested pair of script tags does not end it.
        state = 0
        for part in _SCRIPT_PART.finditer(page, at):
            found = part[0].lower()
            if found == "<!--":
                state = state or 1
            elif found.endswith(">"):
                state = 0
            elif found == "<script":
                state = 2 if state else 0
            elif state < 2:
                return part.start()
            else:
                state = 1
    return plain.start() if plain else len(page)


def _empty(tag: str, start: int) -> bool:
    """Whether a start tag closes itself; a slash at the end of an unquoted value does not count."""
    if not tag.endswith("/>"):
        return False
    end = max((m.end() for m in _PAIRS.finditer(tag, start)), default=0)
    return end < len(tag) - 1


def _unseen(tag: str, start: int) -> bool:
    """Whether the attributes of a tag hide its element."""
    found: dict[str, str] = {}
    for name, a, b, c in _PAIRS.findall(tag, start):
        found.setdefault(name.lower(), a or b or c)
    if "hidden" in found:
        return True
    display = ""
    for declaration in re.sub(r"/\*.*?\*/", "", html.unescape(found.get("style", "")), flags=re.S).split(";"):
        key, _, value = declaration.partition(":")
        if key.strip().lower() == "display":
            display = value.strip()
    return bool(_NONE.fullmatch(display))


def _words(tag: str) -> tuple[str, ...]:
    found = _ATTRIBUTE.findall(tag)
    return tuple("." + w for _, a, b, c in found for w in _SPLIT.split((a or b or c).lower()) if w)


def targets(blocks: Sequence[Block]) -> list[int]:
    """Which blocks belong to the main text, by page structure."""
    def apart(path: Sequence[str]) -> bool:
        return any(p in ASIDE_TAGS or p[0] == "." and p[1:] in ASIDE_WORDS for p in path)

    def inside(path: Sequence[str]) -> bool:
        return any(p in MAIN_TAGS or p[0] == "." and p[1:] in MAIN_WORDS for p in path)

    framed = any(inside(b.path) for b in blocks)
    return [int(not apart(b.path) and (inside(b.path) if framed else
                                       len(b.text.split()) >= 10 and 3 * b.linked < len(b.text))) for b in blocks]


@functools.lru_cache(maxsize=100_000)
def _hashed(word: str, dims: int) -> tuple[int, float]:
    h = xxhash.xxh3_64_intdigest(word)
    return h % dims, 1.0 if h >> 63 else -1.0


@functools.lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_DIMS, np.float32)
    for word in (*path, "".join(path[-3:])):
        place, sign = _hashed("path " + word, PATH_DIMS)
        out[place] += sign
    return out


MEASURES = 6
INPUTS = PATH_DIMS + WORD_DIMS + MEASURES


def page_vectors(blocks: Sequence[Block]) -> np.ndarray:
    """One row per block: tag path, words, measures."""
    out = np.zeros((len(blocks), INPUTS), np.float32)
    for i, block in enumerate(blocks):
        out[i, :PATH_DIMS] = _path_vector(block.path)
        words = _WORD.findall(block.text.lower())
        if words:
            pairs = [_hashed(w, WORD_DIMS) for w in words]
            bag = np.bincount([p for p, _ in pairs], [s for _, s in pairs], WORD_DIMS)
            out[i, PATH_DIMS:PATH_DIMS + WORD_DIMS] = bag / max(1e-9, float(np.linalg.norm(bag)))
        size = len(block.text)
        out[i, -MEASURES:] = (np.log1p(len(words)) / 4, block.linked / size, sum(map(block.text.count, ".,;:!?")) / size * 10,
                              len(block.path) / 10, i / len(blocks), block.text[-1] in ".!?")
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scan(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """One direction of the LSTM over (time, page, inputs); padding leaves the state as it is."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, held = np.zeros((steps, pages, HIDDEN), np.float32), []
    ready = x @ w[:INPUTS] + w[-1]
    for t in range(steps):
        z = ready[t] + h @ w[INPUTS:-1]
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        new = f * c + i * g
        if keep:
            held.append((i, f, o, g, h, c, np.tanh(new), m))
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        out[t] = h
    return out, held


def _scan_back(x: np.ndarray, held: list, w: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Gradient of the weights of one direction."""
    dw = np.zeros_like(w)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(held) - 1, -1, -1):
        i, f, o, g, h, c, tanh, m = held[t]
        dh = dh + grad[t]
        cell = np.where(m, dc + dh * o * (1 - tanh ** 2), 0)
        dz = np.hstack([cell * g * i * (1 - i), cell * c * f * (1 - f), np.where(m, dh * tanh, 0) * o * (1 - o), cell * i * (1 - g ** 2)])
        dw[:INPUTS] += x[t].T @ dz
        dw[INPUTS:-1] += h.T @ dz
        dw[-1] += dz.sum(0)
        dc = np.where(m, cell * f, dc)
        dh = np.where(m, dz @ w[INPUTS:-1].T, dh)
    return dw


class Labeller:
    """Bidirectional LSTM with a logistic output per block; small enough to travel with a task."""

    def __init__(self, seed: int = 11):
        random = np.random.default_rng(seed)
        shape = (INPUTS + HIDDEN + 1, 4 * HIDDEN)
        self.ahead, self.back = (random.normal(0, 0.12, shape).astype(np.float32) for _ in range(2))
        for w in (self.ahead, self.back):
            w[-1, HIDDEN:2 * HIDDEN] = 1.0  # remember by default
        self.out = random.normal(0, 0.2, 2 * HIDDEN + 1).astype(np.float32)

    @staticmethod
    def padded(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)), bool)
        for k, page in enumerate(pages):
            x[:len(page), k], mask[:len(page), k] = page, True
        return x, mask

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        a, held_a = _scan(x, mask, self.ahead, keep)
        b, held_b = _scan(x[::-1], mask[::-1], self.back, keep)
        both = np.concatenate([a, b[::-1]], axis=2)
        return _sigmoid(both @ self.out[:-1] + self.out[-1]), (both, held_a, held_b)

    def probabilities(self, pages: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Of every block of every page; pages are grouped by length."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        for start in range(0, len(order), GROUP):
            some = order[start:start + GROUP]
            p, _ = self.forward(*self.padded([pages[i] for i in some]))
            for k, i in enumerate(some):
                out[i] = p[:len(pages[i]), k]
        return out

    def train(self, pages: Sequence[np.ndarray], labels: Sequence[Sequence[int]], turns: int = 12, rate: float = 0.01,
              seed: int = 5) -> None:
        """Adam on the cross entropy of all blocks, batches of 32 pages."""
        random = np.random.default_rng(seed)
        weights = [self.ahead, self.back, self.out]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(turns):
            order = random.permutation(len(pages))
            for start in range(0, len(order), 32):
                some = order[start:start + 32]
                x, mask = self.padded([pages[i] for i in some])
                target = np.zeros(mask.shape, np.float32)
                for k, i in enumerate(some):
                    target[:len(labels[i]), k] = labels[i]
                p, (both, held_a, held_b) = self.forward(x, mask, keep=True)
                error = np.where(mask, p - target, 0) / max(1, mask.sum())
                spread = error[:, :, None] * self.out[:-1]
                grads = [_scan_back(x, held_a, self.ahead, spread[:, :, :HIDDEN]),
                         _scan_back(x[::-1], held_b, self.back, spread[::-1, :, HIDDEN:]),
                         np.append((both * error[:, :, None]).sum((0, 1)), error.sum()).astype(np.float32)]
                step += 1
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)


def disguised(blocks: Sequence[Block], random: np.random.Generator) -> list[Block]:
    """The page with its telling elements and classes replaced by plain ones."""
    plain = {t: "div" for t in (*MAIN_TAGS, *ASIDE_TAGS) if random.random() < 0.6}
    return [Block(b.text, tuple(plain.get(p, p) for p in b.path if p[0] != "." or random.random() < 0.5), b.linked) for b in blocks]


def train_labeller(pages: Sequence[str], seed: int = 3) -> Labeller:
    """A labeller from at most ``TRAIN_PAGES`` pages, every other one also in disguise."""
    random = np.random.default_rng(seed)
    vectors, labels = [], []
    for i, page in enumerate(pages[:TRAIN_PAGES]):
        blocks = cut_page(page)
        if not blocks:
            continue
        target = targets(blocks)
        for version in ([blocks, disguised(blocks, random)] if i % 2 else [blocks]):
            vectors.append(page_vectors(version))
            labels.append(target)
    labeller = Labeller()
    if vectors:
        labeller.train(vectors, labels)
    return labeller


def training_pages(df: DataFrame, page_id: str = "page_id", page: str = "html", most_chars: int = 200_000) -> list[str]:
    """A bounded sample: the pages with the smallest hashes of their id, huge ones left out."""
    rows = df.where(F.length(page) <= most_chars).select(F.col(page_id).alias("i"), F.col(page).alias("p"))
    ids = rows.select("i").orderBy(F.xxhash64("i"), "i").limit(TRAIN_PAGES)
    found = rows.join(F.broadcast(ids.distinct()), "i").limit(TRAIN_PAGES).collect()
    return [r.p for r in sorted(found, key=lambda r: (str(r.i), r.p))]


def extract_text(df: DataFrame, labeller: Labeller, page: str = "html", text: str = "text") -> DataFrame:
    """``df`` without ``page`` and with ``text``, the main text of each page."""
    keep = [c for c in without(df, [text]) if c != page]
    spread = df.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for start in range(0, batch.num_rows, GROUP * 4):
                pages = [cut_page(p) for p in batch.column(page).slice(start, GROUP * 4).to_pylist()]
                chosen = spread.value.probabilities([page_vectors(blocks) for blocks in pages])
                texts += [" ".join(b.text for b, p in zip(blocks, some) if p >= 0.5) for blocks, some in zip(pages, chosen)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])
    return df.mapInArrow(run, schema)
