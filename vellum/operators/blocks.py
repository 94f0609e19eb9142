"""Blocks and lists of a page: a recursive cut at white space, and lines that markers join into nested lists.

Both look at a whole page, whose rows a page bounds; pages are spread over the tasks, and each is settled in one call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vellum.functions.text import list_marker

MOST_DEPTH = 64
BAND, GUTTER = 0.6, 1.5
ALIGNED, NESTED = 0.5, 4.0


def _gaps(low: np.ndarray, high: np.ndarray, least: float) -> list[np.ndarray]:
    """Indices parted where nothing reaches over a gap of `least`, in ascending order of low."""
    order = np.lexsort((high, low))
    reach = np.maximum.accumulate(high[order])
    cuts = np.flatnonzero(low[order][1:] - reach[:-1] >= least) + 1
    return np.split(order, cuts)


def xy_cut(left: np.ndarray, bottom: np.ndarray, right: np.ndarray, top: np.ndarray, line_gap: float, height: float) -> np.ndarray:
    """The block of each box, numbered in reading order: a region is cut into bands at gaps of line_gap and 0.6 heights or more,
    else into columns at gutters of 1.5 heights; bands that neighbour and have the same columns are cut into columns first."""
    out, number = np.zeros(len(left), dtype=np.int64), 0

    def columns(at: np.ndarray) -> list[np.ndarray]:
        return [at[g] for g in _gaps(left[at], right[at], GUTTER * height)]

    def same(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
        """As many columns, more than one, each over its counterpart."""
        return len(a) == len(b) > 1 and all(left[x].min() < right[y].max() and left[y].min() < right[x].max() for x, y in zip(a, b))

    def cut(at: np.ndarray, depth: int) -> None:
        nonlocal number
        if len(at) > 1 and depth < MOST_DEPTH:
            bands = [at[g] for g in _gaps(-top[at], -bottom[at], line_gap + BAND * height)]
            if len(bands) > 1:
                groups: list[list[np.ndarray]] = []
                for band in bands:
                    if groups and same(columns(groups[-1][-1]), columns(band)) and len(columns(np.concatenate([*groups[-1], band]))) > 1:
                        groups[-1].append(band)
                    else:
                        groups.append([band])
                if len(groups) > 1 or len(groups[0]) == 1:
                    for group in groups:
                        cut(np.concatenate(group), depth + 1)
                    return
            parts = columns(at)
            if len(parts) > 1:
                for part in parts:
                    cut(part, depth + 1)
                return
            if len(bands) > 1:
                for band in bands:
                    cut(band, depth + 1)
                return
        out[at] = number
        number += 1

    if len(left):
        cut(np.arange(len(left)), 0)
    return out


def blocks(boxes: DataFrame, keys: list[str], line_gap: float, height: float) -> DataFrame:
    """boxes (left, bottom, right, top) with block, in reading order on each page."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in boxes.dtypes) + ", block long"

    def run(page: pd.DataFrame) -> pd.DataFrame:
        sides = (page[c].to_numpy(dtype=float) for c in ("left", "bottom", "right", "top"))
        return page.assign(block=xy_cut(*sides, line_gap, height))

    return boxes.groupBy(*keys).applyInPandas(run, schema)


def item_numbers(left: list[float], markers: list[dict | None], height: float) -> list[tuple[int, int] | None]:
    """(list, level) of each line in order; None without a marker. A line goes on with the innermost open list that it is aligned
    with and whose marker it follows (a bullet the same bullet; a number, letter or numeral the one before plus one, in one
    style), else it begins a list inside the one it is indented from, by four heights at most, else a list of its own. A letter
    that is a numeral too is read as what goes on. Lists of one item are dropped unless they are bullets or nested from 1 on."""
    out: list[tuple[int, int] | None] = []
    open_: list[dict] = []
    found: list[dict] = []

    def values(m: dict) -> dict[str, int]:
        if m["kind"] == "Letter":
            return {"Letter": m["value"]} | ({"Roman": m["roman"]} if m["roman"] else {})
        return {m["kind"]: m["roman"] if m["kind"] == "Roman" else m["value"]}

    for x, m in zip(left, markers):
        if m is None:
            out.append(None)
            continue
        own = values(m)
        for k in reversed(range(len(open_))):
            top = open_[k]
            goes_on = [kind for kind in top["next"] if kind in own and top["style"] == m["style"] and (kind == "Bullet" and top["mark"] == m["numbering"] or kind != "Bullet" and own[kind] == top["next"][kind])]
            if abs(top["left"] - x) <= ALIGNED * height and goes_on:
                del open_[k + 1 :]
                top["next"] = {kind: own[kind] + 1 for kind in goes_on}
                top["size"] += 1
                out.append((top["number"], k))
                break
        else:
            while open_ and not (ALIGNED * height < x - open_[-1]["left"] <= NESTED * height):
                open_.pop()
            new = {"number": len(found), "left": x, "style": m["style"], "mark": m["numbering"], "next": {kind: v + 1 for kind, v in own.items()}, "size": 1, "keep": m["kind"] == "Bullet" or (bool(open_) and 1 in own.values())}
            found.append(new)
            open_.append(new)
            out.append((new["number"], len(open_) - 1))
    kept = {f["number"]: k for k, f in enumerate(f for f in found if f["size"] > 1 or f["keep"])}
    return [None if x is None or x[0] not in kept else (kept[x[0]], x[1]) for x in out]


def lists(lines: DataFrame, keys: list[str], height: float) -> DataFrame:
    """keys, seq, list, level of the lines (seq, left, word: the first word) that are items of lists."""
    marked = lines.select(*keys, "seq", "left", list_marker(lines["word"]).alias("marker"))
    schema = ", ".join(f"`{c}` {dict(lines.dtypes)[c]}" for c in [*keys, "seq"]) + ", list int, level int"

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("seq")
        found = item_numbers(page["left"].tolist(), [None if m is None else dict(m.asDict() if hasattr(m, "asDict") else m) for m in page["marker"]], height)
        page = page.assign(list=[-1 if f is None else f[0] for f in found], level=[-1 if f is None else f[1] for f in found])
        return page.loc[page["list"] >= 0, [*keys, "seq", "list", "level"]]

    return marked.groupBy(*keys).applyInPandas(run, schema)
