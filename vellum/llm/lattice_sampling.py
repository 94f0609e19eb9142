"""SentencePiece encoding and decoding, with distinct sampled segmentations.

Encoding is the library's own, a distinct word at a time (`word_table`); decoding joins pieces and byte pieces again.

A text's lattice has an edge for every vocabulary piece at every place (byte pieces where a character has none), weighted
by ALPHA times the piece's score. Backward sums give each place its total weight, so an edge's conditional probability is
known, and a segmentation's probability is the product over its edges. Segmentations are sampled without replacement by
Gumbel top-k: the search tree's node is a run of decided edges, its bound the largest Gumbel-perturbed log-probability
below it. A* search pops the node with the largest bound: following conditional draws down to a leaf emits the
segmentation that has exactly this perturbed value; the undecided siblings of every edge on the way are one node each,
with their joint weight and a Gumbel truncated at the value above. The first k leaves are k distinct segmentations, a
sample without replacement. The next bound is the threshold; a segmentation of log-probability l was included with chance
1 - exp(-exp(l - threshold)) (its logarithm is the inclusion score). All noise comes from a hash of (row key, place in the
search), so a row's samples depend on nothing but its key and text.

No piece has a blank behind another character, so no edge crosses from one word to the next. Lattices and ids of distinct
words are built once and kept, those of the first KEPT_CHARS characters from chunk to chunk. The rows of a chunk are searched in
step: each round draws the next segmentation of all of them in numpy. Logarithms of probabilities are summed as multiples
of 2**-24 in integers, so a row's figures don't depend on the rows beside it.
"""

from __future__ import annotations

import dataclasses
import functools
import heapq
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from vellum.llm.common import by_batch
from vellum.llm.token_counts import STABLE
from vellum.llm.word_table import UNEVEN, filled, ragged, split_blanks

K = 2
ALPHA = 1e-3
#: A chunk is so many bytes of texts and the text that passes them.
CHUNK_BYTES = 3 << 19
#: Characters of distinct words whose lattices a worker keeps (some 50 bytes each); those of later words are built for their chunk.
KEPT_CHARS = 3 << 19
#: Words that are drawn at once.
DRAWN = 1 << 17
BLANK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONES = (1 << 64) - 1
#: Logarithms of chances are multiples of 1 / LOG_UNIT, cumulative chances of 1 / CHANCE_UNIT.
LOG_UNIT, CHANCE_UNIT = 2.0**24, 2.0**40


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _uniform(seed: np.ndarray) -> np.ndarray:
    """In the open interval (0, 1)."""
    return ((_mix(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        crossing = [i for i in normal if BLANK in self.pieces[i].lstrip(BLANK)]
        if crossing:
            raise ValueError("a piece has a blank behind another character; words can't be told apart")
        self.bytes = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.score = np.array([m.get_score(i) for i in range(n)])
        self.byte_weight = ALPHA * float(self.score[normal].min()) * 1.5
        self.longest = max(len(self.pieces[i]) for i in normal)
        runs = [self._hashes(self.pieces[i]) for i in normal]
        hashes = np.array([h[-1] for h in runs], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(normal)[order]
        #: By a hash's upper bits: whether a piece may have it, and whether one may begin with it.
        self.seen, self.begins = np.zeros(1 << 22, dtype=bool), np.zeros(1 << 22, dtype=bool)
        self.seen[hashes >> np.uint64(42)] = True
        self.begins[np.array([x for h in runs for x in h[:-1]], dtype=np.uint64) >> np.uint64(42)] = True
        #: What each id stands for: its piece with blanks, one byte, or nothing where the library decides (controls, unknown).
        shown = {i: self.pieces[i].replace(BLANK, " ").encode() for i in normal} | {int(i): bytes([b]) for b, i in enumerate(self.bytes)}
        self.shown = pa.array([shown.get(i) for i in range(n)], pa.large_binary())

    @staticmethod
    def _hashes(piece: str) -> list[int]:
        """Of each beginning of piece, the whole last."""
        h, out = 0, []
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & _ONES
            out.append(h)
        return out

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The texts (UTF-8) of ids end to end: pieces and bytes joined, the blank before the first word left out. Ids of
        neither kind, and bytes that are no UTF-8, go to the library."""
        taken = self.shown.take(pa.array(ids.astype(np.int64)))
        at = np.frombuffer(taken.buffers()[1], dtype="<i8", count=len(ids) + 1)[cuts].tolist()
        data, odd = taken.buffers()[2], np.zeros(len(cuts) - 1, dtype=bool)
        if taken.null_count:
            odd = np.diff(np.concatenate([[0], np.cumsum(taken.is_null().to_numpy(zero_copy_only=False))])[cuts]) > 0
        raw, out = memoryview(data) if data else memoryview(b""), []
        for k, (low, high) in enumerate(zip(at, at[1:])):
            own = bytes(raw[low:high]).removeprefix(b" ") if high > low else b""
            try:
                own.decode()
            except UnicodeDecodeError:
                odd[k] = True
            out.append(self.model.decode(ids[cuts[k] : cuts[k + 1]].tolist()).encode() if odd[k] else own)
        return out


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One stays with a worker, whatever tasks it runs."""
    return Vocabulary(path)


class Lattice:
    """Of distinct words, end to end: edges in the order of their start, with conditional probabilities."""

    def __init__(self, known: Vocabulary, words: list[str]):
        v = self.vocabulary = known
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.code, n = code, len(code)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths)
        self.starts = (ends - lengths).astype(np.int32)  # of words
        left = np.repeat(ends, lengths) - np.arange(n)  # characters to the word's end
        h, at, wide = np.zeros(n, dtype=np.uint64), np.arange(n), code.astype(np.uint64)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []  # length, starts, ids
        many = np.zeros(n, dtype=np.int32)  # edges that start at each place
        for size in range(1, v.longest + 1):
            keep = left[at] >= size
            at, h = at[keep], h[keep]
            if not len(at):
                break
            h = h * _BASE + wide[at + size - 1] + np.uint64(1)
            top = h >> np.uint64(42)
            maybe, on = np.flatnonzero(v.seen[top]), v.begins[top]
            place = np.minimum(np.searchsorted(v.hashes, h[maybe]), len(v.hashes) - 1)
            hit = v.hashes[place] == h[maybe]
            a, own = at[maybe[hit]], v.ids[place[hit]]
            if size == 1:  # a character that is no piece is its bytes
                lone = np.ones(n, dtype=bool)
                lone[a] = False
                lone = np.flatnonzero(lone)
                a, own = np.concatenate([a, lone]), np.concatenate([own, np.full(len(lone), -1)])
            many[a] += 1
            found.append((size, a, own))
            at, h = at[on], h[on]
        first = np.concatenate([[0], np.cumsum(many)])
        start, size, ids = (np.empty(first[-1], dtype=np.int64) for _ in range(3))
        free = first[:-1].copy()
        for length, a, own in reversed(found):  # longer edges come first
            to = free[a]
            start[to], size[to], ids[to] = a, length, own
            free[a] += 1
        weight = np.where(ids >= 0, ALPHA * v.score[ids], v.byte_weight)
        final = left[start] == size
        total = self._backward(start, size, weight, left, final)
        ahead = np.where(final, 0.0, total[np.minimum(start + size, n - 1)])
        log_p = weight + ahead - total[start]
        p = np.exp(log_p)
        run = np.cumsum(np.rint(p * CHANCE_UNIT).astype(np.int64))
        # Some 20 bytes an edge. log_others: of the chance of all the edges beside one; there are none where it is alone.
        with np.errstate(divide="ignore"):
            self.log_others = np.where(np.diff(first)[start] == 1, -np.inf, np.log1p(-np.minimum(p, 1.0))).astype(np.float32)
        self.first, self.start, self.ids = first.astype(np.int32), start.astype(np.int32), ids.astype(np.int16 if len(v.pieces) < 1 << 15 else np.int32)
        self.size, self.ends_word = size.astype(np.uint8 if v.longest < 256 else np.int32), final
        self.log_q = np.rint(np.maximum(log_p, -127.0) * LOG_UNIT).astype(np.int32)
        self.upto = ((run - np.concatenate([[0], run])[first[start]]) * (1 / CHANCE_UNIT)).astype(np.float32)

    def after(self, edges: np.ndarray) -> np.ndarray:
        """The places behind edges."""
        return self.start[edges] + self.size[edges]

    @staticmethod
    def _backward(start: np.ndarray, size: np.ndarray, weight: np.ndarray, left: np.ndarray, final: np.ndarray) -> np.ndarray:
        total, steps = np.zeros(len(left)), left[start]
        order = np.argsort(steps.astype(np.uint16 if len(steps) and steps.max() < 65536 else np.int64), kind="stable")
        steps = steps[order]
        cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(order)]
        for low, high in zip(cuts, cuts[1:]):
            e = order[low:high]
            if not len(e):
                continue
            s = start[e]
            x = weight[e] + np.where(final[e], 0.0, total[np.minimum(s + size[e], len(total) - 1)])
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(x, new)
            total[s[new]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff([*new, len(x)]))), new))
        return total

    def draw(self, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each place to its word's end: (edges ordered by item and place, how many each item has)."""
        if len(at) > DRAWN:
            parts = [self.draw(at[k : k + DRAWN], seed[k : k + DRAWN]) for k in range(0, len(at), DRAWN)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        edges, items, counts = [], [], np.zeros(len(at), dtype=np.int64)
        live, here, step = np.arange(len(at)), at, 0
        while len(live):
            e, last = self.first[here], self.first[here + 1] - 1
            open_ = np.flatnonzero(e < last)  # the others have one edge only
            u = _uniform(seed[live[open_]] + np.uint64(step * int(_BASE) & _ONES))
            mine, end = e[open_], last[open_]
            todo = np.flatnonzero(self.upto[mine] < u)
            while len(todo):
                mine[todo] += 1
                todo = todo[(mine[todo] < end[todo]) & (self.upto[mine[todo]] < u[todo])]
            e[open_] = mine
            edges.append(e)
            items.append(live)
            counts[live] += 1
            on = ~self.ends_word[e]
            here, live, step = self.after(e[on]), live[on], step + 1
        begin, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), dtype=np.int32)
        for k, (live, e) in enumerate(zip(items, edges)):
            out[begin[live] + k] = e
        return out, counts

    def piece_ids(self, edges: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of paths end to end, and their cuts; a character without a piece is its UTF-8 bytes' pieces."""
        ids = self.ids[edges].astype(np.int32)
        single = np.flatnonzero(ids < 0)
        if not len(single):
            return ids, cuts
        code = self.code[self.start[edges[single]]].astype(np.int64)
        code[(code >= 0xD800) & (code < 0xE000)] = ord("?")
        wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        n = np.ones(len(ids), dtype=np.int64)
        n[single] = wide
        ends = np.cumsum(n)
        out = np.repeat(ids, n)
        begin = ends[single] - wide
        for size in range(1, 5):
            own, c = begin[wide == size], code[wide == size]
            for k in range(size):
                byte = (c >> (6 * (size - 1 - k))) & 0x3F | 0x80
                if k == 0:
                    byte = c if size == 1 else (c >> (6 * (size - 1))) | (0xF00 >> size) & 0xFF
                out[own + k] = self.vocabulary.bytes[byte]
        return out, np.concatenate([[0], ends])[cuts]


class Store:
    """Lattices end to end in arrays that grow by doubling; what was added last can be taken off again."""

    #: Arrays by what they have an entry for, and those that name places of characters.
    KINDS = {"starts": "words", "code": "chars", "first": "chars", **dict.fromkeys(("start", "size", "ids", "ends_word", "log_q", "log_others", "upto"), "edges")}
    PLACES = ("starts", "start")

    def __init__(self, known: Vocabulary):
        self.vocabulary, self.sizes, self.held = known, {"words": 0, "chars": 0, "edges": 0}, {}

    def add(self, lattice: Lattice) -> None:
        old = dict(self.sizes)
        more = {"words": len(lattice.starts), "chars": len(lattice.code), "edges": len(lattice.ids)}
        self.sizes = {k: old[k] + n for k, n in more.items()}
        for name, kind in self.KINDS.items():
            new, at = getattr(lattice, name), old[kind]
            need = at + more[kind] + 1  # one place more for the end behind the last character
            if name not in self.held or len(self.held[name]) < need:
                larger = np.empty(max(need, 2 * len(self.held.get(name, ()))), dtype=new.dtype)
                larger[:at] = self.held[name][:at] if name in self.held else 0
                self.held[name] = larger
            shift = old["chars"] if name in self.PLACES else old["edges"] if name == "first" else 0
            np.add(new, new.dtype.type(shift), out=self.held[name][at : at + len(new)]) if shift else self.held[name].__setitem__(slice(at, at + len(new)), new)

    def view(self) -> Lattice:
        out = object.__new__(Lattice)
        out.vocabulary = self.vocabulary
        for name, kind in self.KINDS.items():
            setattr(out, name, self.held[name][: self.sizes[kind] + (name == "first")])
        return out


def _truncated(log_mass, top, u):
    """Gumbels of these locations, given that they are at most top."""
    return log_mass - np.log(np.exp(np.minimum(log_mass - top, 700)) - np.log(u))  # -inf of an empty node stays -inf


def _per_row(key: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """key a place, and the number of the place within its row."""
    return np.repeat(key, sizes), (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)


def seeds(keys: np.ndarray, number: int, sizes: np.ndarray) -> np.ndarray:
    """Of each word of each row, for draw `number`."""
    key, place = _per_row(keys + np.uint64(number * 0xD1342543DE82EF95 & _ONES), sizes)
    return _mix(place + key)


class Search:
    """Gumbel top-k over the segmentations of rows of words, all rows in step: `paths` (edges), `logs` and `scores` of each row."""

    def __init__(self, lattice: Lattice, words: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int):
        self.lattice, self.at, self.offsets, self.keys, self.k = lattice, lattice.starts[words], offsets, keys, k
        n = len(keys)
        self.paths: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.heaps: list[list[tuple]] = [[] for _ in range(n)]
        sizes = np.diff(offsets)
        edges, counts = lattice.draw(self.at, seeds(keys, 0, sizes))
        cuts = np.concatenate([[0], np.cumsum(counts)])[offsets]
        root = -np.log(-np.log(_uniform(keys ^ np.uint64(0x5DEECE66D))))
        rows = np.flatnonzero(sizes > 0)
        for i in np.flatnonzero(sizes == 0).tolist():
            self.paths[i].append(np.zeros(0, dtype=np.int32))
        self._add(rows, [edges[cuts[i] : cuts[i + 1]] for i in rows.tolist()], np.zeros(len(rows), dtype=np.int64), root[rows], 0)
        for number in range(1, k):
            rows = np.array([i for i in rows.tolist() if self.heaps[i]], dtype=np.int64)
            if len(rows):
                self._round(rows, number)
        threshold = [-h[0][0] if h else -np.inf for h in self.heaps]
        self.logs = [[int(lattice.log_q[p].sum(dtype=np.int64)) / LOG_UNIT for p in own] for own in self.paths]
        self.scores = [[self._score(x - t) for x in own] for own, t in zip(self.logs, threshold)]

    @staticmethod
    def _score(above: float) -> float:
        """Logarithm of the chance to be included, by how far a segmentation lies above the threshold."""
        if above == np.inf:
            return 0.0
        return math.log(-math.expm1(-math.exp(min(above, 700.0)))) if above > -30 else above

    def _add(self, rows: np.ndarray, paths: list[np.ndarray], fixed: np.ndarray, value: np.ndarray, number: int) -> None:
        """A new path of each row, and the nodes of the siblings of its edges behind the fixed ones: of those a row can only
        take k, so the best k + 1 are kept."""
        if not len(rows):
            return
        lattice = self.lattice
        for i, p in zip(rows.tolist(), paths):
            self.paths[i].append(p)
        edges, sizes = np.concatenate(paths), np.array([len(p) for p in paths])
        begin = np.cumsum(sizes) - sizes
        q = lattice.log_q[edges].astype(np.int64)
        before = np.cumsum(q) - q
        before -= np.repeat(before[begin], sizes)
        key, place = _per_row(self.keys[rows] ^ np.uint64((number + 1) * 0x2545F4914F6CDD1D & _ONES), sizes)
        bound = np.full(len(edges), -np.inf)
        can = np.flatnonzero(place >= np.repeat(fixed, sizes).astype(np.uint64))
        others = lattice.log_others[edges[can]]
        can, others = can[np.isfinite(others)], others[np.isfinite(others)]
        mass = before[can] * (1 / LOG_UNIT) + others
        bound[can] = _truncated(mass, np.repeat(value, sizes)[can], _uniform(place[can] * _BASE + key[can]))
        for _ in range(self.k + 1):
            top = np.maximum.reduceat(bound, begin)
            best = np.flatnonzero((bound == np.repeat(top, sizes)) & np.isfinite(bound))
            if not len(best):
                break
            row = np.searchsorted(begin, best, side="right") - 1
            once = np.flatnonzero(np.diff(row, prepend=-1))
            best, row = best[once], row[once]
            for r, j, x, e in zip(row.tolist(), (best - begin[row]).tolist(), bound[best].tolist(), edges[best].tolist()):
                heapq.heappush(self.heaps[rows[r]], (-x, number, j, (e,)))
            bound[best] = -np.inf

    def _round(self, rows: np.ndarray, number: int) -> None:
        """The best node of each row: its best leaf keeps the edges before it, takes one of the siblings and draws on."""
        lattice, tails, starts, kept, fixed, value = self.lattice, [], [], [], [], []
        seed = self.keys[rows] ^ np.uint64(number * 0x9E3779B97F4A7C15 + 77 & _ONES)
        chance, other = _uniform(seed).tolist(), _uniform(seed + np.uint64(1)).tolist()
        for r, i in enumerate(rows.tolist()):
            bound, parent, j, gone = heapq.heappop(self.heaps[i])
            base = self.paths[i][parent]
            here = lattice.start[base[j]]
            options = [e for e in range(int(lattice.first[here]), int(lattice.first[here + 1])) if e not in gone]
            chances = [math.exp(x / LOG_UNIT) for x in lattice.log_q[options].tolist()]
            total, run, pick = chance[r] * sum(chances), 0.0, len(options) - 1
            for k, p in enumerate(chances[:-1]):
                run += p
                if run >= total:
                    pick = k
                    break
            rest = sum(chances) - chances[pick] if len(options) > 1 else 0.0
            if rest > 0:  # the siblings that remain, below this leaf's value
                mass = int(lattice.log_q[base[:j]].sum(dtype=np.int64)) / LOG_UNIT + math.log(rest)
                heapq.heappush(self.heaps[i], (-float(_truncated(mass, -bound, other[r])), parent, j, (*gone, options[pick])))
            e = options[pick]
            word = int(self.offsets[i] + np.count_nonzero(lattice.ends_word[base[:j]]))
            kept.append(np.append(base[:j], np.int32(e)))
            tails.append(np.concatenate([lattice.after(np.array([e] if not lattice.ends_word[e] else [], dtype=np.int64)), self.at[word + 1 : self.offsets[i + 1]]]))
            fixed.append(j + 1)
            value.append(-bound)
        sizes = np.array([len(t) for t in tails])
        edges, counts = lattice.draw(np.concatenate(tails), seeds(self.keys[rows], number, sizes))
        cuts = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        self._add(rows, [np.concatenate([a, edges[low:high]]) for a, low, high in zip(kept, cuts, cuts[1:])], np.array(fixed), np.array(value), number)


def sample(lattice: Lattice, words: np.ndarray, key: int, k: int) -> tuple[list[np.ndarray], list[float], list[float]]:
    """k (or all, if fewer) distinct segmentations of a text of these words: edges, log-probabilities, inclusion scores."""
    found = Search(lattice, words, np.array([0, len(words)]), np.array([key], dtype=np.uint64), k)
    return found.paths[0], found.logs[0], found.scores[0]


@dataclasses.dataclass
class Coded:
    """Of texts: the library's ids and the texts decoded from them, sampled ids (end to end, with cuts), log-probabilities, inclusion scores."""

    ids: np.ndarray
    cuts: np.ndarray
    decoded: list[bytes]
    sampled: np.ndarray
    sample_cuts: np.ndarray
    logs: list[list[float]]
    scores: list[list[float]]


class Coder:
    """Encoding, decoding and sampling of batches; one to a Python worker and query."""

    def __init__(self, path: str, k: int = K):
        self.vocabulary, self.k = vocabulary(path), k
        self.known: dict[str, int] = {}
        self.store, self.raw, self.raw_cuts = Store(self.vocabulary), np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        self.store.add(Lattice(self.vocabulary, []))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Offsets and words of texts: the pieces between stable blanks; an empty text has none."""
        if not pc.any(pc.match_substring_regex(texts, UNEVEN)).as_py() and not pc.any(pc.equal(pc.binary_length(texts), 0)).as_py():
            return split_blanks(texts)
        parts = [STABLE.split(t) if t else [] for t in texts.to_pylist()]
        return np.cumsum([0, *map(len, parts)]), pa.array([w for p in parts for w in p], pa.large_string())

    def _looked_up(self, distinct: list[str]) -> tuple[np.ndarray, Lattice, np.ndarray, np.ndarray]:
        """The place of each word in a lattice, that lattice, and the library's ids of its words with their cuts; all hold until
        the next call."""
        known, n = self.known, len(self.known)
        new = [w for w in distinct if w not in known]
        if not new:
            return np.array([known[w] for w in distinct], dtype=np.int64), self.store.view(), self.raw, self.raw_cuts
        before = dict(self.store.sizes)
        self.store.add(Lattice(self.vocabulary, [BLANK + w.replace(" ", BLANK) for w in new]))
        found = self.vocabulary.model.encode(new, num_threads=1)
        raw = np.concatenate([self.raw, np.fromiter(itertools.chain.from_iterable(found), dtype="<u4")])
        cuts = np.concatenate([self.raw_cuts, len(self.raw) + np.cumsum([len(x) for x in found])])
        fresh = dict(zip(new, range(n, n + len(new))))
        place = np.array([known[w] if w in known else fresh[w] for w in distinct], dtype=np.int64)
        lattice = self.store.view()
        if self.store.sizes["chars"] <= KEPT_CHARS:
            known.update(fresh)
            self.raw, self.raw_cuts = raw, cuts
        else:
            self.store.sizes = before
        return place, lattice, raw, cuts

    def run(self, texts: pa.Array, keys: list[int]) -> Coded:
        offsets, words = self.words(texts)
        coded = words.dictionary_encode()
        distinct, lattice, raw, cuts = self._looked_up(coded.dictionary.to_pylist())
        place = distinct[coded.indices.to_numpy()]
        sizes = np.diff(cuts)[place]
        ids = raw[ragged(cuts[place], sizes)]
        id_cuts = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        found = Search(lattice, place, np.asarray(offsets), np.array(keys, dtype=np.uint64), self.k)
        paths = [p for own in found.paths for p in own]
        sampled, sample_cuts = lattice.piece_ids(np.concatenate([np.zeros(0, dtype=np.int32), *paths]), np.cumsum([0, *map(len, paths)]))
        return Coded(ids, id_cuts, self.vocabulary.decode_all(ids, id_cuts), sampled, sample_cuts, found.logs, found.scores)


def row_key(doc_id: object, text: str) -> int:
    """The seed of a row: its doc_id and text."""
    return xxhash.xxh3_64_intdigest(f"{doc_id}\x00{text}".encode("utf-8", "replace"))


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _packed(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """An entry of 32-bit integers, end to end, to each stretch."""
    raw = pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, dtype="<i8") * 4), raw])


def unpacked(ids: bytes) -> list[int]:
    """The ids of a packed entry."""
    return np.frombuffer(ids, dtype="<u4").tolist()


def encode(docs: DataFrame, path: str, k: int = K) -> DataFrame:
    """Of every row of docs (doc_id, text; other columns are left out): doc_id, ids (the library's, packed as little-endian
    32-bit integers, see `unpacked`), n_pieces, ids_crc32, round_trip (decoding the ids gives the text back), n_samples, and
    an entry a sample in sample_ids (packed likewise), sample_pieces, sample_crc32, log_probability, log_inclusion.

    Null and empty texts have no pieces and one sample, the empty one; a text with fewer than k segmentations has them all,
    each with inclusion score 0; rows that repeat both doc_id and text have the same samples; an empty table gives an empty
    one. No shuffle."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(coder: Coder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = filled(batch.column(1))
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // CHUNK_BYTES)) + 1).tolist(), len(size)]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield chunk(coder, batch.column(0).slice(low, high - low), texts.slice(low, high - low))

    def chunk(coder: Coder, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        plain = texts.to_pylist()
        x = coder.run(texts, [row_key(d, t) for d, t in zip(doc_ids.to_pylist(), plain)])
        samples = np.cumsum([0, *map(len, x.logs)])
        crcs = lambda packed: [zlib.crc32(v.as_buffer() or b"") for v in packed]
        flat = lambda lists: np.array([v for own in lists for v in own], dtype=float)
        ids, sampled = _packed(x.ids, x.cuts), _packed(x.sampled, x.sample_cuts)
        return pa.record_batch(
            {
                "doc_id": doc_ids,
                "ids": ids,
                "n_pieces": pa.array(np.diff(x.cuts), pa.int64()),
                "ids_crc32": pa.array(crcs(ids), pa.int64()),
                "round_trip": pa.array([d == t.encode("utf-8", "replace") for d, t in zip(x.decoded, plain)]),
                "n_samples": pa.array(np.diff(samples), pa.int32()),
                "sample_ids": pa.ListArray.from_arrays(pa.array(samples, pa.int32()), sampled),
                "sample_pieces": _lists(np.diff(x.sample_cuts), samples, pa.int64()),
                "sample_crc32": _lists(np.array(crcs(sampled)), samples, pa.int64()),
                "log_probability": _lists(flat(x.logs), samples, pa.float64()),
                "log_inclusion": _lists(flat(x.scores), samples, pa.float64()),
            }
        )

    schema = f"doc_id {kind}, ids binary, n_pieces long, ids_crc32 long, round_trip boolean, n_samples int, sample_ids array<binary>, sample_pieces array<long>, sample_crc32 array<long>, log_probability array<double>, log_inclusion array<double>"
    return by_batch(docs.select("doc_id", "text"), run, schema, make=lambda: Coder(path, k))
