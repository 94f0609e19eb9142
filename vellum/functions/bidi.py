"""Bidirectional text: embedding levels and visual order of a paragraph, by the Unicode algorithm (UAX #9).

Character classes come from the interpreter's Unicode data; paired brackets (N0) are matched by their names' mirror pairs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DEPTH = 125
_ISOLATES = ("LRI", "RLI", "FSI")
_EMBEDDINGS = ("RLE", "LRE", "RLO", "LRO")
_REMOVED = (*_EMBEDDINGS, "PDF", "BN")
_NEUTRAL = ("B", "S", "WS", "ON", "FSI", "LRI", "RLI", "PDI")
#: Opening and closing brackets (fixed values).
BRACKETS = dict(zip("([{༺༼᚛⁅⁽₍⌈⌊❨❪❬❮❰❲❴⟅⟦⟨⟪⟬⟮⦃⦅⦇⦉⦋⦑⦓⦕⦗⧘⧚⧼〈《「『【〔〖〘〚﹙﹛﹝（［｛｟｢", ")]}༻༽᚜⁆⁾₎⌉⌋❩❫❭❯❱❳❵⟆⟧⟩⟫⟭⟯⦄⦆⦈⦊⦌⦒⦔⦖⦘⧙⧛⧽〉》」』】〕〗〙〛﹚﹜﹞）］｝｠｣"))
_CLOSING = {v: k for k, v in BRACKETS.items()}


def _matching(kinds: list[str]) -> tuple[dict[int, int], dict[int, int]]:
    """Isolate initiators and the PDIs that end them, both ways."""
    ends, begins, open_ = {}, {}, []
    for i, k in enumerate(kinds):
        if k in _ISOLATES:
            open_.append(i)
        elif k == "PDI" and open_:
            ends[open_[-1]] = i
            begins[i] = open_.pop()
    return ends, begins


def _first_strong(kinds: list[str], at: int, beyond: int, ends: dict[int, int]) -> int | None:
    while at < beyond:
        if kinds[at] in ("L", "R", "AL"):
            return int(kinds[at] != "L")
        at = ends.get(at, beyond) if kinds[at] in _ISOLATES else at + 1
    return None


def levels(text: str, base: int | None = None) -> list[int]:
    """The embedding level of each character of a paragraph; base: its direction (0 or 1), or by its first strong character."""
    kinds = [unicodedata.bidirectional(c) or "L" for c in text]
    original, n = list(kinds), len(kinds)
    ends, begins = _matching(kinds)
    if base is None:
        base = _first_strong(kinds, 0, n, ends) or 0
    out = [base] * n
    # X1 to X8: explicit levels.
    stack: list[tuple[int, str | None, bool]] = [(base, None, False)]
    over_isolates = over_embeddings = valid = 0
    odd = lambda x: x + 1 + x % 2
    even = lambda x: x + 2 - x % 2
    for i, k in enumerate(original):
        if k in _EMBEDDINGS:
            out[i] = stack[-1][0]
            new = odd(stack[-1][0]) if k[0] == "R" else even(stack[-1][0])
            if new <= MOST_DEPTH and not over_isolates and not over_embeddings:
                stack.append((new, {"O": k[0]}.get(k[2]), False))
            elif not over_isolates:
                over_embeddings += 1
        elif k in _ISOLATES:
            out[i] = stack[-1][0]
            if stack[-1][1]:
                kinds[i] = stack[-1][1]
            right = k == "RLI" or (k == "FSI" and _first_strong(original, i + 1, ends.get(i, n), ends) == 1)
            new = odd(stack[-1][0]) if right else even(stack[-1][0])
            if new <= MOST_DEPTH and not over_isolates and not over_embeddings:
                valid += 1
                stack.append((new, None, True))
            else:
                over_isolates += 1
        elif k == "PDI":
            if over_isolates:
                over_isolates -= 1
            elif valid:
                over_embeddings = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                valid -= 1
            out[i] = stack[-1][0]
            if stack[-1][1]:
                kinds[i] = stack[-1][1]
        elif k == "PDF":
            out[i] = stack[-1][0]
            if over_isolates:
                pass
            elif over_embeddings:
                over_embeddings -= 1
            elif not stack[-1][2] and len(stack) > 1:
                stack.pop()
        elif k == "B":
            out[i] = base
        else:
            out[i] = stack[-1][0]
            if stack[-1][1] and k != "BN":
                kinds[i] = stack[-1][1]
    # X10: isolating run sequences of the characters that aren't removed.
    kept = [i for i in range(n) if original[i] not in _REMOVED]
    runs: list[list[int]] = []
    for i in kept:
        if runs and out[runs[-1][-1]] == out[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    by_first = {run[0]: run for run in runs}
    for run in runs:
        if original[run[0]] == "PDI" and run[0] in begins:
            continue
        sequence = list(run)
        while original[sequence[-1]] in _ISOLATES and sequence[-1] in ends:
            sequence += by_first[ends[sequence[-1]]]
        _resolve(text, original, kinds, out, sequence, kept, base)
    # I1, I2.
    for i in kept:
        if out[i] % 2 == 0:
            out[i] += {"R": 1, "AN": 2, "EN": 2}.get(kinds[i], 0)
        else:
            out[i] += kinds[i] in ("L", "AN", "EN")
    before = base
    for i in range(n):  # what was removed takes the level before it
        if original[i] in _REMOVED:
            out[i] = before
        before = out[i]
    # L1: separators, and white space before them or at the end, are at the base level.
    back = True
    for i in reversed(range(n)):
        if original[i] in ("B", "S"):
            out[i], back = base, True
        elif back and (original[i] in ("WS", *_ISOLATES, "PDI", *_REMOVED)):
            out[i] = base
        else:
            back = False
    return out


def _resolve(text: str, original: list[str], kinds: list[str], out: list[int], s: list[int], kept: list[int], base: int) -> None:
    """W1 to W7 and N0 to N2 on one isolating run sequence, whose places are s."""
    level = out[s[0]]
    at = {i: k for k, i in enumerate(kept)}
    edge = lambda x: "R" if x % 2 else "L"
    before = out[kept[at[s[0]] - 1]] if at[s[0]] else base
    after = out[kept[at[s[-1]] + 1]] if at[s[-1]] + 1 < len(kept) and original[s[-1]] not in _ISOLATES else base
    sos, eos = edge(max(level, before)), edge(max(level, after))
    t = [kinds[i] for i in s]
    n = len(t)
    last = sos
    for k in range(n):  # W1
        if t[k] == "NSM":
            t[k] = "ON" if last in (*_ISOLATES, "PDI") else last
        last = t[k]
    strong = sos
    for k in range(n):  # W2, W3
        if t[k] in ("L", "R", "AL"):
            strong = t[k]
        elif t[k] == "EN" and strong == "AL":
            t[k] = "AN"
    t = ["R" if x == "AL" else x for x in t]
    for k in range(1, n - 1):  # W4
        if t[k] == "ES" and t[k - 1] == t[k + 1] == "EN" or t[k] == "CS" and t[k - 1] == t[k + 1] and t[k - 1] in ("EN", "AN"):
            t[k] = t[k - 1]
    k = 0
    while k < n:  # W5
        if t[k] == "ET":
            j = k
            while j < n and t[j] == "ET":
                j += 1
            if (k and t[k - 1] == "EN") or (j < n and t[j] == "EN"):
                t[k:j] = ["EN"] * (j - k)
            k = j
        else:
            k += 1
    t = ["ON" if x in ("ES", "ET", "CS") else x for x in t]  # W6
    strong = sos
    for k in range(n):  # W7
        if t[k] in ("L", "R"):
            strong = t[k]
        elif t[k] == "EN" and strong == "L":
            t[k] = "L"
    # N0: pairs of brackets take a direction that stands in them.
    own, side = edge(level), lambda x: "R" if x in ("R", "EN", "AN") else x
    open_, pairs = [], []
    for k in range(n):
        c = unicodedata.normalize("NFC", text[s[k]])
        if t[k] != "ON":
            continue
        if c in BRACKETS:
            if len(open_) == 63:
                break
            open_.append((BRACKETS[c], k))
        elif c in _CLOSING:
            for j in reversed(range(len(open_))):
                if open_[j][0] == c:
                    pairs.append((open_[j][1], k))
                    del open_[j:]
                    break
    for a, b in sorted(pairs):
        inside = {side(x) for x in t[a + 1 : b]} & {"L", "R"}
        if own in inside:
            new = own
        elif inside:
            context = next((side(t[j]) for j in reversed(range(a)) if side(t[j]) in ("L", "R")), sos)
            new = context if context != own else own
        else:
            continue
        for j in (a, b):
            t[j] = new
            while j + 1 < n and original[s[j + 1]] == "NSM":
                j += 1
                t[j] = new
    k = 0
    while k < n:  # N1, N2
        if t[k] in _NEUTRAL:
            j = k
            while j < n and t[j] in _NEUTRAL:
                j += 1
            left, right = side(t[k - 1]) if k else sos, side(t[j]) if j < n else eos
            t[k:j] = [left if left == right else own] * (j - k)
            k = j
        else:
            k += 1
    for i, x in zip(s, t):
        kinds[i] = x


def visual(text: str, base: int | None = None) -> str:
    """The paragraph in visual order: runs of each level and above turned round, the highest first; brackets mirrored."""
    level = levels(text, base)
    order = list(range(len(text)))
    for high in range(max(level, default=0), 0, -1):
        k = 0
        while k < len(order):
            if level[order[k]] >= high:
                j = k
                while j < len(order) and level[order[j]] >= high:
                    j += 1
                order[k:j] = reversed(order[k:j])
                k = j
            else:
                k += 1
    mirror = BRACKETS | _CLOSING | dict(zip("<>«»‹›", "><»«›‹"))
    return "".join(mirror.get(text[i], text[i]) if level[i] % 2 else text[i] for i in order)


def visual_order(text: Column) -> Column:
    """text, a paragraph, in visual order; only texts with a character from right to left go to Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else visual(t))

    turned = text.rlike("[\\x{590}-\\x{8FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFC}\\x{10800}-\\x{10FFF}\\x{1E800}-\\x{1EFFF}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{200F}]")
    return F.when(turned, run(F.when(turned, text))).otherwise(text)
