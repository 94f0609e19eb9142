"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference: each kind of labelled credential makes a prefix tree whose states count how often they were passed and
how often a string ended there. States are merged in the order red-blue search visits them, if Hoeffding's bound finds
their symbol and end frequencies compatible, and their successors' too (the merge folds both subtrees). What remains is a
deterministic probabilistic automaton. It reads symbol classes (CLASSES), and each class's probability is shared equally
by its characters, so long random runs keep a likelihood that ordinary words don't reach.

A candidate is a maximal run of 8 or more credential characters (dots at its ends left out), with a digit and a letter, that
no base span touches. All candidates are scored: it is a secret if some automaton's log-likelihood beats that of the automaton
of ordinary strings by MARGIN a character and by EVIDENCE in all, so a short run has to be the more unlike ordinary ones. The
base patterns' spans always stay; the method only adds spans.

The labelled strings are made by a seeded rule from the public descriptions of credential formats (`labelled`), since the
tables label no credentials; `Grammar` takes others.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import by_batch

# Fixed values of the result contract: kinds and patterns of the base, in the order they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "grammar")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Runs in which access keys, hex strings and candidates lie.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
MIN_CANDIDATE = 8

#: Symbol classes: digits, hex letters and other letters of each case, marks.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ", "+": "+", "/": "/", "_": "_", ".": ".", "=": "=", "-": "-"}
SYMBOL = {c: k for k, chars in CLASSES.items() for c in chars}
SHARE = {k: -math.log(len(chars)) for k, chars in CLASSES.items()}

ALPHA = 0.05
MARGIN = 0.7
EVIDENCE = 14.0
SAMPLES = 400
MIX = 0.2
#: States that fewer strings passed are neither merged nor merged into: they would make loops out of single strings.
LEAST_SEEN = 8


class Automaton:
    """A prefix tree of strings of symbols, merged by the ALERGIA rule."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[Counter] = [Counter()]
        self.ended: list[int] = [0]
        self.seen: list[int] = [0]
        drawn = Counter(c for s in strings for c in s) + Counter({"": len(strings)})
        self.usual = {c: (drawn[c] + 0.5) / (drawn.total() + 6) for c in [*CLASSES, ""]}
        for s in strings:
            self._add(s)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._compact()

    def _add(self, s: str) -> None:
        at = 0
        self.seen[0] += 1
        for c in s:
            self.passed[at][c] += 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.passed.append(Counter())
                self.ended.append(0)
                self.seen.append(0)
            at = self.next[at][c]
            self.seen[at] += 1
        self.ended[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ended[a], self.seen[a], self.ended[b], self.seen[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.passed[a][c], self.seen[a], self.passed[b][c], self.seen[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """b, a tree, into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ended[a] += self.ended[b]
            self.passed[a] += self.passed[b]
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            # The best known state first; what is left in the end are tails with too little evidence, which stay trees.
            parent, c = blue.pop(max(range(len(blue)), key=lambda k: (self.seen[self.next[blue[k][0]][blue[k][1]]], -k)))
            state = self.next[parent][c]
            if state in red or self.seen[state] < LEAST_SEEN:
                continue
            for r in red:
                if self.seen[r] >= LEAST_SEEN and self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in known and self.seen[self.next[r][c]] >= LEAST_SEEN]

    def _compact(self) -> None:
        """Keeps the states that strings reach and that were seen often enough, as tables of logarithms; the tree's tails go."""
        number, todo = {0: 0}, [0]
        for at in todo:
            for c in sorted(self.next[at]):
                to = self.next[at][c]
                if to not in number and self.seen[to] >= LEAST_SEEN:
                    number[to] = len(number)
                    todo.append(to)
        mixed = lambda f, n, c: math.log((1 - MIX) * f / n + MIX * self.usual[c])
        #: Of each state: symbol -> (logarithm of its probability for one character, next state or None); and of an end.
        self.steps = [{c: (mixed(self.passed[at][c], self.seen[at], c) + SHARE[c], number.get(self.next[at].get(c))) for c in CLASSES} for at in todo]
        self.ends = [mixed(self.ended[at], self.seen[at], "") for at in todo]
        self.lost = {c: math.log(MIX * self.usual[c]) + SHARE[c] for c in CLASSES}
        self.lost_end = math.log(MIX * self.usual[""])
        del self.next, self.passed, self.ended, self.seen

    def log_likelihood(self, s: str) -> float:
        """Of a string of characters, its end included. Each state's frequencies are mixed with those of all the strings, and
        a string that leaves the automaton goes on by the latter alone."""
        at, total = 0, 0.0
        for c in s:
            k = SYMBOL[c]
            if at is None:
                total += self.lost[k]
            else:
                p, at = self.steps[at][k]
                total += p
        return total + (self.lost_end if at is None else self.ends[at])


def labelled(seed: int = 7, n: int = SAMPLES) -> tuple[dict[str, list[str]], list[str]]:
    """Labelled strings: credentials by format, and ordinary strings, made from their public formats by a seeded rule."""
    r = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    letters, both = upper + lower + digits, upper + lower + digits + "-_"
    word = lambda a, b: "".join(r.choice(("aeiou", "bcdfghklmnprstvwyz")[(k + first) % 2] if r.random() < 0.8 else lower) for first in (r.randint(0, 1),) for k in range(r.randint(a, b)))
    draw = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    between = lambda chars, a, b: draw(chars, r.randint(a, b))
    many = lambda f: [f() for _ in range(n)]
    good = {
        "access": many(lambda: r.choice(("AKIA", "ASIA")) + draw(upper + "234567", 16)),
        "hex": many(lambda: draw("0123456789abcdef", r.choice((32, 40, 64)))),
        "prefixed": many(lambda: r.choice(("ghp_", "gho_", "ghs_", "npm_")) + draw(letters, 36)),
        "live": many(lambda: r.choice(("sk_live_", "rk_live_", "pk_live_", "sk_test_")) + draw(letters, 24)),
        "chat": many(lambda: r.choice(("xoxb-", "xoxp-")) + f"{draw(digits, 11)}-{draw(digits, 12)}-{draw(letters, 24)}"),
        "maps": many(lambda: "AIza" + draw(both, 35)),
        "personal": many(lambda: "glpat-" + draw(both, 20)),
        "mail": many(lambda: f"SG.{draw(both, 22)}.{draw(both, 43)}"),
        "web": many(lambda: f"eyJ{between(both, 17, 24)}.eyJ{between(both, 20, 40)}.{draw(both, 43)}"),
        "base64": many(lambda: draw(letters + "+/", r.choice((24, 32, 40, 64, 88))) + r.choice(("", "", "=", "=="))),
        "mixed": many(lambda: between(letters, 12, 32)),
    }
    plain = [
        *many(lambda: word(8, 28)),
        *many(lambda: f"{word(3, 9)}-{word(3, 9)}-{word(3, 9)}{r.choice(('', '-' + draw(digits, 4)))}"),
        *many(lambda: f"{word(3, 9)}_{word(3, 9)}_{between(digits, 1, 6)}"),
        *many(lambda: f"{word(3, 9).capitalize()}{word(3, 9).capitalize()}{word(4, 9).capitalize()}{between(digits, 0, 3)}"),
        *many(lambda: f"{word(3, 8)}/{word(3, 8)}/{word(3, 9)}/{between(digits, 1, 5)}"),
        *many(lambda: f"{word(3, 9)}{r.choice('._-')}{word(2, 9)}{between(digits, 0, 4)}.{r.choice(('com', 'org', 'net', 'html', 'py', 'txt'))}"),
        *many(lambda: between(digits, 8, 24)),
        *many(lambda: f"{draw(digits, 4)}-{draw(digits, 2)}-{draw(digits, 2)}{r.choice(('', 'T' + draw(digits, 6), 'T' + draw(digits, 2)))}"),
        *many(lambda: "-".join((draw(digits, 3), draw(digits, 3), draw(digits, 4)))),
        *many(lambda: f"{r.choice(('v', 'R', 'No', 'ch', 'rev', ''))}{between(digits, 1, 3)}.{between(digits, 1, 3)}.{between(digits, 1, 4)}{r.choice(('', '-' + word(2, 6), '-rc' + draw(digits, 1)))}"),
        *many(lambda: word(6, 12).upper() + "-" + word(6, 12).upper() + between(digits, 0, 4)),
        *many(lambda: word(4, 14) + between(digits, 1, 4)),
        *many(lambda: between(upper, 1, 4) + "-" + between(digits, 3, 9)),
        *many(lambda: "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))),  # UUIDs name things; they are no secrets
    ]
    return good, plain


class Grammar:
    """The automata of labelled credentials by kind, and that of ordinary strings. Some hundreds of states: small enough to send."""

    def __init__(self, good: dict[str, list[str]], plain: list[str]):
        coded = lambda strings: ["".join(SYMBOL[c] for c in s) for s in strings]
        self.kinds = {k: Automaton(coded(v)) for k, v in good.items()}
        self.plain = Automaton(coded(plain))

    def is_credential(self, s: str, kinds: list[str] | None = None) -> bool:
        least = self.plain.log_likelihood(s) + max(EVIDENCE, MARGIN * len(s))
        return any(self.kinds[k].log_likelihood(s) > least for k in kinds or self.kinds)


@functools.cache
def grammar() -> Grammar:
    """Inferred once a driver, from `labelled`; executors get it by broadcast."""
    return Grammar(*labelled())


def is_credential(s: str) -> bool:
    return grammar().is_credential(s)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points, leftmost and non-overlapping per kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    for run in RUN.finditer(text):  # a match of either kind that is long enough lies in one run
        if run.end() - run.start() < MIN_ACCESS:
            continue
        if "AKIA" in run[0]:
            out += [(*m.span(), "access") for m in ACCESS.finditer(text, *run.span()) if m.end() - m.start() >= MIN_ACCESS]
        if run.end() - run.start() >= MIN_HEX:
            out += [(*m.span(), "hex") for m in HEX.finditer(text, *run.span()) if m.end() - m.start() >= MIN_HEX]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def added_spans(text: str, base: list[tuple[int, int, str]], known: Grammar) -> list[tuple[int, int, str]]:
    """Spans that the automata add: candidates of the grammar that no base span touches."""
    out = []
    for m in RUN.finditer(text):
        s = m[0]
        if s.isalpha():
            continue
        a = m.start() + len(s) - len(s.lstrip(".="))
        s = s.strip(".")
        s = s.lstrip("=")
        head, _, tail = s.rpartition("=") if "=" in s.rstrip("=") else ("", "", s)
        if head:  # name=value: the value is the candidate
            a, s = a + len(s) - len(tail), tail
            if not tail:
                continue
        b = a + len(s)
        if len(s) >= MIN_CANDIDATE and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and not any(x < b and a < y for x, y, _ in base) and known.is_credential(s):
            out.append((a, b, "grammar"))
    return out


def spans(text: str, known: Grammar | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start, then kind as listed."""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, known or grammar()), key=lambda x: (x[0], KINDS.index(x[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added of every row of docs (doc_id, text; other columns are
    left out). Null and empty texts have no spans (the digest of the empty string); repeated rows are scanned each. No
    shuffle."""
    kind = dict(docs.dtypes)["doc_id"]
    known = docs.sparkSession.sparkContext.broadcast(grammar())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: dict[str, list] = {k: [] for k in KINDS}
        digests, shown = [], []
        for text in batch.column(1).to_pylist():
            base, every = spans(text or "", known.value)
            per = Counter(k for _, _, k in every)
            for k in KINDS:
                n[k].append(per[k])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            shown.append(joined(every))
        cols = [batch.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS[:3]), pa.array(digests), pa.array(shown), pa.array(n["grammar"], pa.int64())]
        return pa.record_batch(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redacted(text: str | None, mark: str = "[SECRET]", known: Grammar | None = None) -> str | None:
    """text with mark in place of every span; spans that overlap are one."""
    if not text:
        return text
    _, every = spans(text, known)
    if not every:
        return text
    out, at, high = [], 0, -1
    for a, b, _ in every:
        if a >= high:
            out += [text[at:a], mark]
        high = at = max(high, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with mark in place of secrets in text; n_chars, if there, counts the new text."""
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    known = docs.sparkSession.sparkContext.broadcast(grammar())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(text_at).to_pylist()
        new = [redacted(t, mark, known.value) for t in old]
        changed = [k for k, (a, b) in enumerate(zip(old, new)) if a != b]
        if not changed:
            return batch
        cols = batch.columns
        cols[text_at] = pa.array(new, cols[text_at].type)
        if chars_at is not None:
            chars = cols[chars_at].to_pylist()
            for k in changed:
                chars[k] = len(new[k])
            cols[chars_at] = pa.array(chars, cols[chars_at].type)
        return pa.record_batch(cols, batch.schema.names)

    return by_batch(docs, run, docs.schema)
