"""HTML extraction by a recurrent block labeller.

A page is cut into blocks: the text between block-level tags, inline markup dissolved. Each block becomes a vector (its tag
path with classes and ids, hashed; all its words, hashed; its length, its share of link text, its place). A bidirectional
LSTM in numpy reads the vectors of the whole page in order, forwards and backwards, so every block is labelled in the
context of the whole document: main text or not. The main text is the main blocks, in page order.

The weights lie beside this module (`html_weights.npz`, of a fixed size); `train_html` made them, from pages of many
skeletons that a seeded rule writes. Scripts, styles, comments and the head are no blocks at all.

Reading a page takes time in proportion to its length, whatever it holds: each character is looked at a bounded number of
times, open elements are counted between fences rather than searched, and a block's path is a set of bits that grows with
the element, not a list that is walked.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import by_batch

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"[\"'>]")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements whose content is no text: up to their end tag, or the page's end; those of the second row only if they have an end tag.
RAW = frozenset("script style title textarea".split())
HIDDEN_TEXT = frozenset("template noscript svg select iframe object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the start of another one ends.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements beyond which an unclosed one doesn't reach for its end.
FENCES = frozenset("html body article main section div nav header footer aside table ul ol form blockquote".split())
#: Block-level elements whose start ends an open paragraph.
BREAKS = FENCES | frozenset("p h1 h2 h3 h4 h5 h6 pre hr dl fieldset figure address".split())

PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 128, 64, 9, 20
DIM = PATH_DIM + WORD_DIM + NUMBERS
WEIGHTS = Path(__file__).with_name("html_weights.npz")


class Block(NamedTuple):
    text: str
    #: Hashed tags, classes, ids and roles of the elements around it, and its own element's tag once more.
    path: int
    depth: int
    #: Characters of link text.
    links: int


class Tag(NamedTuple):
    begin: int
    end: int
    name: str
    closing: bool
    attributes: str


def tags(page: str) -> Iterator[Tag]:
    """Tags of a page, and comments, declarations and hidden elements as tags without a name. A `<` that begins none of
    them is text. A quote that is never closed is an ordinary character; a tag that only ends inside its quotes ends at its
    first `>`."""
    at, last = 0, page.rfind(">")
    last_quote = {q: page.rfind(q) for q in "\"'"}
    no_end = set()  # elements without a further end tag
    dead = set()  # places outside of quotes from which no tag ends
    while (lt := page.find("<", at)) >= 0 and lt < last:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            yield Tag(lt, at, "", False, "")
            continue
        if page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
            yield Tag(lt, at, "", False, "")
            continue
        closing = page.startswith("/", lt + 1)
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            at = lt + 1
            continue
        here, seen, end = name.end(), [], -1
        while (stop := STOP.search(page, here)) and stop.start() not in dead:
            if stop[0] == ">":
                end = stop.start()
                break
            seen.append(stop.start())
            here = stop.end() if stop.start() >= last_quote[stop[0]] else page.find(stop[0], stop.end()) + 1
        if end < 0:
            dead.update(seen)
            end = page.find(">", name.end())
        at, tag = end + 1, name[0].lower()
        attributes = page[name.end() : end]
        if not closing and tag in RAW | HIDDEN_TEXT and not (tag == "svg" and attributes.endswith("/")) and tag not in no_end:
            stop = _end_tag(tag).search(page, at)
            if not stop:
                no_end.add(tag)
            if stop or tag in RAW:
                at = stop.end() if stop else len(page)
                yield Tag(lt, at, "", False, "")
                continue
        yield Tag(lt, at, tag, closing, attributes)


@functools.cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.IGNORECASE)


@functools.lru_cache(maxsize=65536)
def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


@functools.lru_cache(maxsize=4096)
def _bits(tag: str, attributes: str) -> int:
    named = [w.lower() for x in NAMED.finditer(attributes) for w in re.findall(r"[A-Za-z]+", x[1] or x[2] or x[3] or "")]
    return sum(1 << k for k in {_bucket(w, PATH_DIM) for w in (tag, *named)})


def blocks(page: str) -> list[Block]:
    """The blocks that have text; character references decoded, white space inside a block turned into one space."""
    out: list[Block] = []
    path: list[tuple[str, int]] = []  # (tag, bits of the path so far)
    open_: list[Counter] = [Counter()]  # open elements since each fence
    every: Counter = Counter()
    held: list[str] = []
    links, in_link, at, in_head = 0, 0, 0, False

    def end_block() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                bits = path[-1][1] | 1 << _bucket("leaf " + path[-1][0], PATH_DIM) if path else 0
                out.append(Block(text, bits, len(path), links))
        links = 0

    def push(tag: str, attributes: str) -> None:
        path.append((tag, (path[-1][1] if path else 0) | _bits(tag, attributes[:1000])))
        every[tag] += 1
        if tag in FENCES:
            open_.append(Counter())
        else:
            open_[-1][tag] += 1

    def pop() -> str:
        tag, _ = path.pop()
        every[tag] -= 1
        if tag in FENCES:
            open_.pop()
        else:
            open_[-1][tag] -= 1
        return tag

    def close(names: tuple[str, ...]) -> None:
        """Ends the innermost of these elements and all in it, unless a fence stands between."""
        if any(open_[-1][n] for n in names):
            end_block()
            while pop() not in names:
                pass

    for tag in tags(page):
        if tag.begin > at and not in_head:
            held.append(page[at : tag.begin])
            links += in_link and len(held[-1])
        at, name = tag.end, tag.name
        if not name:
            continue
        if name == "head":
            in_head = not tag.closing
            continue
        if name == "body":
            in_head = False
        if name in INLINE:
            if name == "a":
                in_link = not tag.closing
        elif tag.closing:
            end_block()
            if name not in FENCES:
                close((name,))
            elif every[name]:
                while pop() != name:
                    pass
            in_link = 0
        else:
            end_block()
            if name in VOID:
                continue
            if name in ENDS:
                close(ENDS[name])
            elif name in BREAKS:
                close(("p",))
            if not (tag.attributes.endswith("/") and name not in FENCES):
                push(name, tag.attributes)
    if not in_head and at < len(page):
        held.append(page[at:])
    end_block()
    return out


def vectors(found: list[Block]) -> np.ndarray:
    """One row of DIM numbers to a block."""
    n = len(found)
    x = np.zeros((n, DIM), dtype=np.float32)
    if not n:
        return x
    raw = np.frombuffer(b"".join(b.path.to_bytes(PATH_DIM // 8, "little") for b in found), dtype=np.uint8).reshape(n, -1)
    x[:, :PATH_DIM] = np.unpackbits(raw, axis=1, bitorder="little")
    words = [b.text.lower().split() for b in found]
    sizes = np.array([len(w) for w in words])
    at = np.fromiter((_bucket(w, WORD_DIM) for own in words for w in own), dtype=np.int64, count=int(sizes.sum()))
    counts = np.bincount(np.repeat(np.arange(n) * WORD_DIM, sizes) + at, minlength=n * WORD_DIM).reshape(n, WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.sqrt(counts / sizes[:, None])
    size = np.array([len(b.text) for b in found], dtype=np.float32)
    place = np.arange(n)
    x[:, -NUMBERS:] = np.stack(
        [
            np.minimum(np.log1p(size) / 8, 1.5), np.array([b.links for b in found]) / size, [any(c in b.text for c in ".!?") for b in found], place / n, place == 0,
            np.minimum(np.array([b.depth for b in found]) / 8, 2), size / size.max(), [b.text[-1] in ".!?" for b in found], [any(c in b.text for c in "\u00a9|\u00bb") for b in found],
        ], 1
    )
    return x


class Labeller:
    """A bidirectional LSTM with one logistic output a block; weights are plain arrays."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        scale = lambda *shape: (r.standard_normal(shape) * 0.15).astype(np.float32)
        self.w = {f"{d}{n}": v for d in "fb" for n, v in (("x", scale(DIM, 4 * HIDDEN)), ("h", scale(HIDDEN, 4 * HIDDEN)), ("c", np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)))}
        self.w |= {"o": scale(2 * HIDDEN + DIM), "a": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: pages x blocks x DIM; where mask is 0 the state stays. keep: what gradients need, step by step."""
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        pre = x @ self.w[f"{d}x"] + self.w[f"{d}c"]
        hs, kept = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = pre[:, t] + h @ self.w[f"{d}h"]
            gates = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new_c = f * c + i * u
            tc = np.tanh(new_c)
            if keep:
                kept.append((t, h, c, i, f, o, u, tc, m))
            h, c = np.where(m > 0, o * tc, h), np.where(m > 0, new_c, c)
            hs[:, t] = h
        return hs, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        (hf, kf), (hb, kb) = self._run(x, mask, "f", keep), self._run(x, mask, "b", keep)
        z = np.concatenate([hf, hb, x], 2)
        return 1 / (1 + np.exp(-np.clip(z @ self.w["o"] + self.w["a"][0], -30, 30))), (z, kf, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, (z, kf, kb) = self.forward(x, mask, keep=True)
        total = max(1.0, float(mask.sum()))
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum()) / total
        dz = ((p - y) * mask / total).astype(np.float32)
        out = {"o": np.einsum("nt,ntk->k", dz, z), "a": np.array([dz.sum()], np.float32)}
        dh_all = dz[:, :, None] * self.w["o"]
        for d, kept, low in (("f", kf, 0), ("b", kb, HIDDEN)):
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            dx, dhh, db = np.zeros_like(self.w[f"{d}x"]), np.zeros_like(self.w[f"{d}h"]), np.zeros_like(self.w[f"{d}c"])
            for t, h0, c0, i, f, o, u, tc, m in reversed(kept):
                dh = dh + dh_all[:, t, low : low + HIDDEN]
                own, dco = dh * m, dc * m
                dct = own * o * (1 - tc * tc) + dco
                dg = np.concatenate([dct * u * i * (1 - i), dct * c0 * f * (1 - f), own * tc * o * (1 - o), dct * i * (1 - u * u)], 1)
                dx += x[:, t].T @ dg
                dhh += h0.T @ dg
                db += dg.sum(0)
                dh = dh * (1 - m) + dg @ self.w[f"{d}h"].T
                dc = dc * (1 - m) + dct * f
            out |= {f"{d}x": dx, f"{d}h": dhh, f"{d}c": db}
        return loss, out

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each block of each page to be main text. Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            group = [order[at]]
            at += 1
            while at < len(order) and len(group) < 256 and (len(group) + 1) * len(pages[order[at]]) <= 65536:
                group.append(order[at])
                at += 1
            x, mask = padded([pages[k] for k in group])
            p, _ = self.forward(x, mask)
            for row, k in enumerate(group):
                out[k] = p[row, : len(pages[k])]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(pages), max(map(len, pages)), DIM), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
        mask[k, : len(p)] = 1
    return x, mask


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(pages), max(map(len, pages)), DIM), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
        mask[k, : len(p)] = 1
    return x, mask


@functools.cache
def trained() -> Labeller:
    """The labeller with the weights that `train_html` stored."""
    net = Labeller()
    with np.load(WEIGHTS) as stored:
        net.w = {k: stored[k] for k in stored.files}
    return net


def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    found = [blocks(p or "") for p in pages]
    chances = net.probabilities([vectors(b) for b in found])
    return [" ".join(x.text for x, p in zip(b, chance) if p >= 0.5) for b, chance in zip(found, chances)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html; other columns are left out). Null or empty html
    and pages without main blocks have the empty text; a null url stays; repeated rows are read each; an empty table gives
    an empty one. No shuffle."""
    weights = pages.sparkSession.sparkContext.broadcast(trained().w)  # of a fixed size
    kind = dict(pages.dtypes)["page_id"]

    def run(net: Labeller, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(batch.column(2).to_pylist(), net)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.large_string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def make() -> Labeller:
        net = Labeller()
        net.w = weights.value
        return net

    return by_batch(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long", rows=256, make=make)
