"""Blocks by white space and lists by markers."""

import random

import numpy as np
import pytest

from vellum.operators.blocks import item_numbers, xy_cut


def marker(kind, value=0, roman=0, style=0, numbering=None):
    return {"kind": kind, "style": style, "value": value, "roman": roman, "numbering": numbering}


def test_columns_under_a_heading():
    boxes = [(50, 790, 560, 806), *((x, 760 - 12 * k, x + 200, 770 - 12 * k) for x in (50, 320) for k in range(1, 8)), (50, 600, 560, 610)]
    got = xy_cut(*np.array(boxes, dtype=float).T, 2.0, 10.0)
    assert got.tolist() == [0, *[1] * 7, *[2] * 7, 3]
    assert xy_cut(*np.zeros((4, 0)), 2.0, 10.0).tolist() == [] and xy_cut(*np.ones((4, 3)), 2.0, 10.0).tolist() == [0, 0, 0]


def test_bands_with_the_same_columns_are_one():
    boxes = [(x, y, x + 100, y + 10) for y in (700, 680, 640, 620) for x in (50, 300)]  # a wide gap in both columns
    got = xy_cut(*np.array(boxes, dtype=float).T, 2.0, 10.0)
    assert [got[k] for k in (0, 2, 4, 6)] == sorted(got[k] for k in (0, 2, 4, 6)) and max(got[::2]) < min(got[1::2])


def test_lists():
    number, letter, bullet = (lambda v: marker("Number", v)), (lambda v, r=0: marker("Letter", v, r)), marker("Bullet", numbering="Disc")
    assert item_numbers([0, 0, 20, 20, 0], [number(1), number(2), letter(1), letter(2), number(3)], 10.0) == [(0, 0), (0, 0), (1, 1), (1, 1), (0, 0)]
    assert item_numbers([0, 0], [number(1), number(3)], 10.0) == [None, None]  # two lists of one item
    assert item_numbers([0, 0, 0], [letter(8), letter(9, 1), letter(10)], 10.0) == [(0, 0)] * 3  # h, i, j
    assert item_numbers([0, 0], [letter(9, 1), marker("Roman", roman=2)], 10.0) == [(0, 0)] * 2  # i, ii
    assert item_numbers([0, 50], [bullet, bullet], 10.0) == [(0, 0), (1, 0)]  # too far in to be nested
    assert item_numbers([0, 0], [None, bullet], 10.0) == [None, (0, 0)] and item_numbers([], [], 10.0) == []


def test_headers_of_cells_without_joins(spark):
    """Exploded cells count as small as their table: a join would send them to the driver for a broadcast."""
    from vellum.operators import layout
    from vellum.plans import registry

    plan = registry.QUERIES["cell_headers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    cells = [(1, 0, 0, 2, "both", True), (1, 1, 0, 1, "left", True), (1, 1, 1, 1, "", True), (1, 2, 0, 1, "a", False), (1, 2, 1, 1, "b", False), (2, 0, 0, 1, "data", False), (2, 1, 0, 1, "late", True)]
    df = spark.createDataFrame(cells, "t long, row int, col int, col_span int, text string, is_header boolean")
    got = sorted(map(tuple, layout.cell_headers(df, ["t"]).collect()))
    assert got == [(1, 2, 0, ["both", "left"]), (1, 2, 1, ["both"]), (2, 0, 0, [])]


@pytest.mark.parametrize("seed", range(3))
def test_header_rows_of_random_tables(spark, seed):
    from vellum.operators import layout

    r = random.Random(seed)
    cells = [(t, row, col, r.choice((1, 1, 1, 2)), r.choice(("", "12", "7.5", "word")), r.random() < 0.6) for t in range(60) for row in range(r.randint(1, 4)) for col in range(r.randint(1, 3))]

    def wanted(own):
        rows = {k: [c for c in own if c[1] == k] for k in sorted({c[1] for c in own})}
        filled = lambda c: c[4] != ""
        plain = {k: any(filled(c) and not c[5] for c in cs) for k, cs in rows.items()}
        may = {k: k < max(rows) and (any(filled(c) and c[3] > 1 for c in cs) or (all(c[5] or not filled(c) for c in cs) and any(v for j, v in plain.items() if j > k))) for k, cs in rows.items()}
        leads = {k: all(may[j] for j in rows if j <= k) for k in rows}
        if any(leads.values()):
            return leads
        below = [[c for c in own if c[1] > 0 and c[2] == col and filled(c)] for col in {c[2] for c in own}]
        numeric = any(len(cs) >= 2 and sum(c[4] != "word" for c in cs) >= 0.6 * len(cs) for cs in below)
        return {k: k == 0 and k < max(rows) and any(c[4] == "word" for c in cs) and not any(c[4] in ("12", "7.5") for c in cs) and numeric for k, cs in rows.items()}

    df = spark.createDataFrame(cells, "t long, row int, col int, col_span int, text string, bold boolean")
    got = sorted((x["t"], x["row"], x["col"], x["is_header"]) for x in layout.header_rows(df, ["t"]).collect())
    assert got == sorted((c[0], c[1], c[2], wanted([x for x in cells if x[0] == c[0]])[c[1]]) for c in cells)
