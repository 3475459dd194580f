"""HTML extraction by a recurrent block labeller.

A page is cut into blocks, the leaves of its block-level tags. A bidirectional
LSTM in numpy reads a vector of each block, of its tag path and its hashed
words, and labels every block as content or not, with the whole page as
context. It is trained here on pages whose own semantic tags label their
blocks; in training those tags are often hidden, so that text, neighbours and
place must do.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import tokens

#: Pages to train on at most, those of the least hashes, and characters of a page that may be one of them.
TRAIN_PAGES, TRAIN_CHARS = 400, 200_000
#: Hashed dimensions of the tag path and of words, further numbers, units a direction.
PATH, WORDS, NUMBERS, UNITS = 48, 48, 6, 16
EPOCHS, RATE, HIDE, SEED = 8, 0.01, 0.7, 5
#: Blocks of this probability or more are content.
KEEP = 0.5
#: Bytes of HTML labelled at once.
CHUNK = 4 << 20

#: A tag without angle brackets in its attributes, which is the common case: never read beyond the next of them.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^<>"]*+"|'[^<>']*+')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe")}
#: What a head may hold; any other tag, or text, ends it.
_HEAD = {"title", "meta", "link", "base"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr",
}
#: Tags that an opening one of the same group closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CONTENT = {"article", "main"}
_OTHER = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_AD = re.compile(r"(?:^|[-_ ])(?:ad|ads|advert|banner|sponsor|promo|cookie|menu|sidebar|share|social|related)(?:$|[-_ ])", re.I)


class Open:
    """An open tag and all that its blocks need to know of those above: hashed path, with and without what silver() goes by, and what it says."""

    __slots__ = ("above", "block", "content", "dropped", "hidden", "names", "other", "shown", "tag")

    def __init__(self, tag: str, names: tuple[str, ...], above: Open | None):
        self.tag, self.names, self.above = tag, names, above
        self.shown, self.hidden, self.content, self.other = (above.shown, above.hidden, above.content, above.other) if above else (0, 0, False, False)
        self.dropped = tag in ("head", "title") or bool(above and above.dropped)
        self.block = above.block if above and tag in _INLINE else self
        if tag in _INLINE:
            return
        bit = 1 << _place(tag)
        self.shown |= bit
        for n in names:
            self.shown |= 1 << _place("." + n)
        if tag in _OTHER or any(map(_AD.search, names)):
            self.other = True
        if tag in _CONTENT:
            self.content = True
        if tag not in _CONTENT and tag not in _OTHER:
            self.hidden |= bit


@lru_cache(maxsize=100_000)
def _place(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % PATH


@dataclass
class Block:
    """under: the innermost open tag; linked: share of characters in links."""

    under: Open | None
    text: str
    linked: float

    @property
    def path(self) -> tuple[str, ...]:
        """Open tags, each with its class words."""
        out, now = [], self.under
        while now:
            if now.tag not in _INLINE:
                out.append((now.tag, *("." + n for n in now.names)))
            now = now.above
        return tuple(x for part in reversed(out) for x in part)


def _end(page: str, at: int, dead: set[int]) -> int:
    """Where the attributes from ``at`` on end, at the first > that no quotes hold; -1 if nowhere. dead: quotes, met outside of others, from which there is no end."""
    met = []
    while m := _STOP.search(page, at):
        at = m.start()
        if page[at] == ">":
            return at
        if at in dead:
            break
        met.append(at)
        at = page.find(page[at], at + 1) + 1
        if not at:
            break
    dead.update(met)
    return -1


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, in time that follows its length.

    Tags needn't be closed: paragraphs, items, rows and cells end where the next
    one begins, the head where something begins that can't be in it. Scripts,
    styles, titles and the head hold no blocks. What can't be a tag is text.
    """
    out: list[Block] = []
    now: Open | None = None
    open_: dict[str, int] = {}
    parts: list[str] = []
    size = link = anchors = 0
    dead: set[int] = set()

    def flush() -> None:
        nonlocal parts, size, link
        if parts:
            text = " ".join(" ".join(parts).split())
            if text:
                out.append(Block(now, text, link / max(size, 1)))
            parts = []
        size = link = 0

    def shut(tag: str) -> None:
        """Closes the innermost open ``tag``, of which there is one, and all in it."""
        nonlocal now
        while True:
            done = now
            open_[done.tag] -= 1
            now = done.above
            if done.tag == tag:
                return

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            text, at = page[at : lt if lt >= 0 else end], lt if lt >= 0 else end
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        elif m := _TAG.match(page, at):
            text, at = None, m.end()
            closing, tag, rest = m.groups()
        elif at > last:
            text, at = "<", at + 1
        elif m := _NAME.match(page, at):
            stop = _end(page, m.end(), dead)
            if stop < 0:
                text, at = "<", at + 1
            else:
                text, (closing, tag), rest, at = None, m.groups(), page[m.end() : stop], stop + 1
        elif page.startswith(("<!", "<?"), at):
            at = page.find(">", at) + 1
            continue
        else:
            text, at = "<", at + 1
        if text is not None:
            if now and now.dropped:
                if now.tag != "head" or open_.get("title") or text.isspace():
                    continue
                shut("head")
            text = html.unescape(text)
            parts.append(text)
            n = len(text.strip())
            size += n
            link += n if anchors else 0
            continue
        tag = tag.lower()
        if not closing and tag in _RAW:
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        inline = tag in _INLINE
        if not inline or tag == "br":
            flush()
        if tag == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
        if open_.get("head") and tag not in _HEAD and not closing:
            shut("head")
        if tag in _VOID:
            continue
        if closing:
            if open_.get(tag):
                shut(tag)
            continue
        if tag in _CLOSES and now and now.block.tag in _CLOSES[tag]:
            shut(now.block.tag)
        names = tuple(n for f in _CLASS.findall(rest) for x in f for n in x.split()) if "=" in rest else ()
        now = Open(tag, names, now)
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out


def silver(block: Block) -> int | None:
    """1 for content, 0 for other blocks by the page's own semantic tags; None where it has none."""
    if block.under is None:
        return None
    return 0 if block.under.other else 1 if block.under.content else None


@lru_cache(maxsize=100_000)
def _bucket(word: str) -> tuple[int, float]:
    h = crc32(word.encode("utf-8", "surrogatepass"))
    return (h >> 1) % WORDS, 1.0 if h & 1 else -1.0


def vectors(page: list[Block], hidden: bool = False) -> np.ndarray:
    """A row for each block. hidden: without the tags that silver() goes by."""
    out = np.zeros((len(page), PATH + WORDS + NUMBERS), dtype=np.float32)
    paths = np.fromiter(((b.under.hidden if hidden else b.under.shown) if b.under else 0 for b in page), dtype=np.uint64, count=len(page))
    out[:, :PATH] = paths[:, None] >> np.arange(PATH, dtype=np.uint64) & np.uint64(1)
    for i, b in enumerate(page):
        row = out[i]
        words = b.text.split()
        for w in words:
            j, sign = _bucket(w)
            row[PATH + j] += sign
        norm = float(np.linalg.norm(row[PATH : PATH + WORDS]))
        if norm:
            row[PATH : PATH + WORDS] /= norm
        n = len(b.text)
        row[PATH + WORDS :] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, b.linked, i / len(page), min(1.0, 10 * sum(map(b.text.count, ".,;:!?")) / n), np.log1p(len(page)) / 6,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM and a logistic output, with its gradients."""

    def __init__(self, inputs: int, units: int = UNITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(inputs)
        self.units = units
        self.p = {"out": rng.normal(0, 0.3, 2 * units), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, scale, (inputs, 4 * units))
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(units), (units, 4 * units)) * 0.5
            self.p[f"c{d}"] = np.concatenate([np.zeros(units), np.ones(units), np.zeros(2 * units)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """x by time and page, each page's steps in reverse; padding stays behind."""
        t = np.arange(len(x))[:, None]
        return x[np.where(t < lengths, lengths - 1 - t, t), np.arange(x.shape[1])]

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        u = self.units
        gates = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((x.shape[1], u), dtype=np.float32)
        hs, tape = np.zeros((len(x), x.shape[1], u), dtype=np.float32), []
        for t in range(len(x)):
            g = gates[t] + h @ self.p[f"h{d}"]
            i, f, o = _sigmoid(g[:, :u]), _sigmoid(g[:, u : 2 * u]), _sigmoid(g[:, 2 * u : 3 * u])
            z = np.tanh(g[:, 3 * u :])
            before = (h, c)
            c = f * c + i * z
            e = np.tanh(c)
            h = o * e
            hs[t] = h
            tape.append((i, f, o, z, e, *before))
        return hs, tape

    def forward(self, x: np.ndarray, lengths: np.ndarray):
        """Probabilities by time and page, and what the gradients need."""
        back = self._reversed(x, lengths)
        hf, tf = self._run(x, "f")
        hb, tb = self._run(back, "b")
        h = np.concatenate([hf, self._reversed(hb, lengths)], axis=2)
        return _sigmoid(h @ self.p["out"] + self.p["bias"]), (x, back, h, hf, hb, tf, tb)

    def _grad(self, x: np.ndarray, dh: np.ndarray, tape: list, d: str, out: dict) -> None:
        u = self.units
        wh = self.p[f"h{d}"]
        dg = np.zeros((len(x), x.shape[1], 4 * u), dtype=np.float32)
        nh = nc = np.zeros((x.shape[1], u), dtype=np.float32)
        gh = np.zeros_like(wh)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, z, e, h0, c0 = tape[t]
            a = dh[t] + nh
            dc = nc + a * o * (1 - e * e)
            g = np.concatenate([dc * z * i * (1 - i), dc * c0 * f * (1 - f), a * e * o * (1 - o), dc * i * (1 - z * z)], axis=1)
            dg[t] = g
            gh += h0.T @ g
            nh, nc = g @ wh.T, dc * f
        out[f"x{d}"] = np.tensordot(x, dg, axes=([0, 1], [0, 1]))
        out[f"h{d}"] = gh
        out[f"c{d}"] = dg.sum(axis=(0, 1))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> tuple[float, dict]:
        """Mean log loss over the weighed blocks, and its gradients."""
        p, (x, back, h, hf, hb, tf, tb) = self.forward(x, lengths)
        total = max(float(weight.sum()), 1.0)
        loss = -float((weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum()) / total
        d = (weight * (p - y) / total).astype(np.float32)
        out = {"out": np.tensordot(d, h, axes=([0, 1], [0, 1])), "bias": np.array([d.sum()], dtype=np.float32)}
        dh = d[:, :, None] * self.p["out"]
        self._grad(x, dh[:, :, : self.units], tf, "f", out)
        self._grad(back, self._reversed(dh[:, :, self.units :], lengths), tb, "b", out)
        return loss, out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((lengths.max(), len(pages), pages[0].shape[1]), dtype=np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
    return x, lengths


def train(pages: list[str]) -> Labeller:
    """From pages with semantic tags; the others teach nothing. Without any, it labels by its random start."""
    rng = np.random.default_rng(SEED)
    model = Labeller(PATH + WORDS + NUMBERS)
    examples = []
    for page in pages:
        found = blocks(page or "")
        y = [silver(b) for b in found]
        if any(v is not None for v in y):
            examples.append((vectors(found), vectors(found, True), np.array([v or 0 for v in y], dtype=np.float32), np.array([v is not None for v in y], dtype=np.float32)))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        order = [b for i in range(0, len(order), 32) for b in [order[i : i + 32]]]
        for batch in order:
            own = [examples[i] for i in batch]
            x, lengths = _padded([e[1] if rng.random() < HIDE else e[0] for e in own])
            y, weight = np.zeros(x.shape[:2], dtype=np.float32), np.zeros(x.shape[:2], dtype=np.float32)
            for i, e in enumerate(own):
                y[: len(e[2]), i], weight[: len(e[3]), i] = e[2], e[3]
            _, grads = model.gradients(x, y, weight, lengths)
            step += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Each block's probability of being content. Pages of like length are read together."""
    out = [np.zeros(0, dtype=np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 256 and (b - a) * len(pages[order[b]]) < 20_000:
            b += 1
        x, lengths = _padded([vectors(pages[i]) for i in order[a:b]])
        p, _ = model.forward(x, lengths)
        for j, i in enumerate(order[a:b]):
            out[i] = p[: lengths[j], j]
        a = b
    return out


def _sample(pages: DataFrame, column: str, most: int = TRAIN_PAGES) -> list[str]:
    """The ``most`` pages of the least hashes, of those of TRAIN_CHARS characters at most. Partitions send only pages below a bound that about three times as many pass."""
    hashed = pages.select(F.xxhash64(column).alias("h"), column).filter(F.length(column) <= TRAIN_CHARS)
    share = min(1.0, 3 * most / max(1, pages.count()))
    while True:
        low = hashed if share == 1 else hashed.filter(F.col("h") < int(share * 2**64) - 2**63)
        found = low.orderBy("h").limit(most).collect()
        if len(found) == most or share == 1:
            return [r[column] for r in found]
        share = min(1.0, 8 * share)


def extract(pages: DataFrame, keep: float = KEEP, column: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``pages`` without ``column`` and with text (content blocks, one a line), n_blocks and n_content.

    A null page has null text and no blocks; an empty page, or one without
    blocks, has an empty text. Any mark-up is read: tags may be left open and
    what can't be a tag is text. Other columns stay, but those of the added
    names are replaced. Equal pages give equal texts, but for rounding in the
    last place of a probability. Pages are read whole, whatever their length. An
    empty table gives an empty one. The model is trained on ``train_pages`` pages
    at most: those of the least hashes, of all that have TRAIN_CHARS characters
    at most.
    """
    model = train(_sample(pages, column, train_pages))
    bound = pages.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in pages.schema.fields if f.name not in (column, "text", "n_blocks", "n_content")]
    schema = pages.select(*[f"`{f.name}`" for f in kept]).schema.add("text", T.StringType()).add("n_blocks", T.IntegerType()).add("n_content", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bound.value
        for batch in batches:
            source, start = batch.column(batch.num_columns - 1), 0
            while start < batch.num_rows:
                stop, size, own = start, 0, []
                while stop < batch.num_rows and size < CHUNK:
                    page = source[stop].as_py()
                    size += len(page or "")
                    own.append(None if page is None else blocks(page))
                    stop += 1
                found = label(model, [b or [] for b in own])
                texts = [None if b is None else "\n".join(x.text for x, p in zip(b, q) if p >= keep) for b, q in zip(own, found)]
                counts = [len(b or ()) for b in own]
                content = [int((q >= keep).sum()) for q in found]
                columns = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(content, pa.int32())], names=schema.names)
                start = stop

    return pages.select(*[f"`{f.name}`" for f in kept], column).mapInArrow(tokens.tidy(run), schema)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
