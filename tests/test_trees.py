"""Trees of any depth, cycles, unknown parents, roles, copies, renamed keys, labels of captions."""

import math

import pytest

from vellum.operators import assembly, layout, lookups, trees
from vellum.plans import registry


def test_deep_trees_and_cycles(spark):
    rows = [(k, k - 1 if k else None, f"n{k}") for k in range(150)] + [(500, 501, "a"), (501, 500, "b"), (502, 501, "c"), (600, 999, "lost"), (700, 2, None)]
    got = {r["id"]: (r["depth"], r["fqn"]) for r in trees.qualified(spark.createDataFrame(rows, "id int, parent_id int, name string")).collect()}
    assert got == {k: (k, ".".join(f"n{j}" for j in range(k + 1))) for k in range(150)} | {700: (3, "n0.n1.n2")}
    assert trees.qualified(spark.createDataFrame([], "id int, parent_id int, name string")).count() == 0


def test_inheritance_and_order(spark):
    rows = [(1, None, "a", "x", True, 0), (2, 1, "b", None, False, 1), (3, 1, "c", "y", True, 0), (4, 2, "d", None, True, 0)]
    df = spark.createDataFrame(rows, "id int, parent_id int, name string, kind string, is_open boolean, k int")
    got = trees.climbed(df, inherited=["kind"], opened="is_open", ordinal="k").collect()
    assert {r["id"]: (r["kind"], r["visible"]) for r in got} == {1: ("x", True), 2: ("x", True), 3: ("y", True), 4: ("x", False)}
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [1, 3, 2, 4]


def test_long_role_chains(spark):
    rows = [(f"t{k}", f"t{k + 1}") for k in range(90)] + [("t90", "P")]
    got = {r["type"]: r["role"] for r in trees.roles(spark.createDataFrame(rows, "type string, target string"), ["P"]).collect()}
    assert got["t0"] == "P" and set(got.values()) == {"P"}


@pytest.mark.parametrize("names", [["a", "a", "a_1"], ["a_1", "a", "a", "a"], ["x", "x_2", "x", "x", "x_1", "x"], ["b_1_1", "b_1", "b", "b", "b_1", "b_1"]])
def test_first_free_names(spark, names):
    taken, want = set(), []
    for n in names:
        new, k = n, 0
        while new in taken:
            k += 1
            new = f"{n}_{k}"
        taken.add(new)
        want.append(new)
    got = assembly.renamed(spark.createDataFrame(list(enumerate(names)), "id int, name string"), "name", "id").orderBy("id").collect()
    assert [r["new_name"] for r in got] == want


def test_large_boxes_make_few_rows(spark):
    points = spark.createDataFrame([(k, float(k % 40), float(k // 40)) for k in range(1600)], "p int, x double, y double")
    boxes = [(1, 0.0, 0.0, 1e6, 1e6), (2, 3.0, 3.0, 3.5, 3.5), (3, 5.0, -1e9, 6.0, 1e9), (4, 39.0, 39.0, 39.0, 39.0), (5, 50.0, 0.0, 60.0, 1.0)]
    df = spark.createDataFrame(boxes, "b int, left double, bottom double, right double, top double")
    got = {(r["p"], r["b"]) for r in lookups.points_in_boxes(points, df, 1.0).collect()}
    assert got == {(k, b) for k in range(1600) for b, x0, y0, x1, y1 in boxes if x0 <= k % 40 <= x1 and y0 <= k // 40 <= y1}


def test_lines_have_an_anchor(spark):
    """A run of small steps off the baseline breaks where it is half an em off the line's first glyph, not its neighbour."""
    glyphs = [(0, k, "a", 5.0 * k, 100.0 + 2.0 * k, 5.0, 10.0) for k in range(6)] + [(0, 6, "b", 0.0, 110.0, 5.0, 10.0)]
    df = spark.createDataFrame(glyphs, "page int, seq long, text string, x double, y double, advance double, size double")
    got = {r["seq"]: r["line"] for r in layout.numbered_lines(df, ["page"]).collect()}
    assert [got[k] for k in range(7)] == [0, 0, 0, 1, 1, 1, 2]


def test_lines_of_glyphs_without_joins(spark):
    """Glyphs are exploded rows, which count as small as their table: a join would send them to the driver for a broadcast."""
    for name in ("words_of_lines", "page_texts"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "BroadcastExchange" not in plan and plan.count("Exchange") == 1, name


def test_lines_keep_all_columns_and_glyphs(spark):
    glyphs = [(p, k, c, 5.0 * (k % 3), -14.0 * (k // 3), 5.0, 10.0, 2 * k) for p in (None, 1) for k, c in enumerate("abcdef")]
    df = spark.createDataFrame(glyphs, "page int, seq long, text string, x double, y double, advance double, size double, flags int")
    got = layout.numbered_lines(df, ["page"])
    assert got.columns == [*df.columns, "line"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*g, g[1] // 3) for g in glyphs), key=repr)


def test_nearest_of_many_items_sorts_no_pairs(spark):
    """A page's pairs go through hash tables: none of them is sorted, and the same box of many items counts once."""
    items = [(k % 2, 100 - k, float(k % 7), float(k % 5), float(k % 7 + k % 3), float(k % 5)) for k in range(90)]
    points = [(k, k % 3, k % 11 / 2, k % 13 / 2) for k in range(60)]
    df = lookups.nearest(spark.createDataFrame(points, "p int, page int, x double, y double"), spark.createDataFrame(items, "page int, i int, left double, bottom double, right double, top double"), "page", "p", "i")
    want = {p: min((math.hypot(max(x0 - x, x - x1, 0), max(y0 - y, y - y1, 0)), i) for g, i, x0, y0, x1, y1 in items if g == page) for p, page, x, y in points if page < 2}
    assert {r["p"]: (round(r["distance"], 9), r["i"]) for r in df.collect()} == {p: (round(d, 9), i) for p, (d, i) in want.items()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any("struct" in x for x in plan.splitlines() if "SortAggregate" in x and "sqrt" in x.lower())


def test_equal_boxes_meet_once(spark):
    """Copies of boxes and rectangles are compared once, and all their pairs are there."""
    boxes = [(k, float(k % 6), float(k % 4), float(k % 6 + 3), float(k % 4 + 2)) for k in range(2500)]
    rectangles = [(k, 2.0 * (k % 5), 3.0 * (k % 3), 2.0 * (k % 5) + 1, 3.0 * (k % 3) + 1) for k in range(90)]
    a = spark.createDataFrame(boxes, "b int, left double, bottom double, right double, top double")
    b = spark.createDataFrame(rectangles, "r int, r_left double, r_bottom double, r_right double, r_top double")
    got = lookups.boxes_in_rectangles(a, b, 2.0)
    assert got.columns == [*a.columns, *b.columns]
    want = {(*x, *y) for x in boxes for y in rectangles if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4]}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_a") < plan.index("Join Inner") and plan.count("collect_list") == 2
