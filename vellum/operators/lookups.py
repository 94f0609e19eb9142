"""Floor lookups, multiset joins, newest-wins merges, diffs, spatial lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut


def floor_join(probes: DataFrame, keys: DataFrame, by: str, at: str, key: str, ties: str, value: str) -> DataFrame:
    """probes with the value of the greatest key at or below `at` within `by`; of equal keys the one with the largest `ties`.

    One shuffle of both sides by `by`: keys and probes are sorted together, and each probe takes the last key before it."""
    known = keys.select(F.col(by).alias("_by"), F.col(key).alias("_at"), F.lit(0).alias("_side"), F.col(ties).alias("_tie"), F.col(value).alias("_value"))
    asked = probes.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_tie"), F.lit(None).alias("_value"), F.struct(*probes.columns).alias("_probe"))
    both = known.withColumn("_probe", F.lit(None).cast(asked.schema["_probe"].dataType)).unionByName(asked)
    order = Window.partitionBy("_by").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_found", F.last("_value", ignorenulls=True).over(order)).where("_side = 1").select("_probe.*", F.col("_found").alias(value))


def multiset_join(left: DataFrame, right: DataFrame, key: list[str], order_left: str, order_right: str) -> DataFrame:
    """Equal keys paired one to one, in order; each row is used once."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order_left)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order_right)))
    return a.join(b, [*key, "_n"]).drop("_n")


def newest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the greatest version; partial aggregation, so a hot key costs one row a task."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("_row")).select(key, "_row.*")


def diff(older: DataFrame, newer: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change (added, deleted, changed) of keys whose rows differ; null equals null."""
    a = older.select(F.col(key).alias("_a"), F.struct(*columns).alias("_old"))
    b = newer.select(F.col(key).alias("_b"), F.struct(*columns).alias("_new"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change is not null")


#: A box that touches more cells than this isn't listed under them; it is compared with the points of whole columns of cells.
MOST_CELLS = 16


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """All pairs of a point (x, y) and a box (left, bottom, right, top) that holds it, edges inside.

    Boxes are listed under the grid cells that they touch and joined with the points' cells, then compared exactly. A box over
    more than MOST_CELLS cells is listed once for each larger cell (MOST_CELLS times as wide, again and again) that it touches
    at the first size where it touches few: points are looked up at each size in use, so no box makes many rows."""
    at = lambda c, k: F.floor(F.col(c) / (cell * MOST_CELLS**k))
    cells = lambda k: (at("right", k) - at("left", k) + 1) * (at("top", k) - at("bottom", k) + 1)
    size = F.lit(SIZES - 1)
    for k in reversed(range(SIZES - 1)):
        size = F.when(cells(k) <= MOST_CELLS, k).otherwise(size)
    sized = boxes.withColumn("_size", size)
    used = sorted(r[0] for r in sized.select("_size").distinct().collect())  # SIZES rows at most
    low = lambda c: F.element_at(F.array(*[at(c, k) for k in range(SIZES)]), F.col("_size") + 1)
    listed = sized.withColumn("_cx", F.explode(F.sequence(low("left"), low("right")))).withColumn("_cy", F.explode(F.sequence(low("bottom"), low("top"))))
    each = F.array(*[F.struct(F.lit(k).alias("_size"), at("x", k).alias("_cx"), at("y", k).alias("_cy")) for k in used or [0]])
    found = points.withColumn("_c", F.explode(each)).select(*points.columns, "_c.*").join(listed, ["_size", "_cx", "_cy"])
    return found.where("x between left and right and y between bottom and top").drop("_size", "_cx", "_cy")


#: Sizes of cells, each MOST_CELLS times as wide as the one before.
SIZES = 8


#: So many rows with the same box go through a join as one; the boxes of a cell are dealt into so many parts.
ALIKE, PARTS = 1024, 4


def _alike(df: DataFrame, box: list[str], name: str) -> DataFrame:
    """A row for each box and ALIKE of its rows at most, whose other columns stand in the array `name`."""
    every = df.groupBy(*box).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in box])).alias("_rows"))
    starts = F.sequence(F.lit(1), F.size("_rows"), F.lit(ALIKE))
    return every.select(*box, F.explode(F.transform(starts, lambda k: F.slice("_rows", k, ALIKE))).alias(name))


def boxes_in_rectangles(boxes: DataFrame, rectangles: DataFrame, cell: float) -> DataFrame:
    """All pairs of a box and a rectangle (r_left, r_bottom, r_right, r_top) that overlap, edges included: both are listed under
    the cells that they touch, and a pair counts in the cell of its overlap's lower left corner alone.

    Rows with equal boxes are compared once and paired afterwards. As the pairs may be far more than the rows, cells are dealt
    over all partitions of a shuffle, however few bytes go in."""
    spark = boxes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    of = lambda c: F.floor(F.col(c) / cell)
    sides = ["left", "bottom", "right", "top"]

    def listed(df: DataFrame, pre: str, part: Column) -> DataFrame:
        df = df.withColumn("_cx", F.explode(F.sequence(of(f"{pre}left"), of(f"{pre}right")))).withColumn("_cy", F.explode(F.sequence(of(f"{pre}bottom"), of(f"{pre}top"))))
        return df.withColumn("_part", part).repartition(n, "_cx", "_cy", "_part")

    own = listed(_alike(boxes, sides, "_a"), "", F.pmod(F.xxhash64(*sides, "_a"), F.lit(PARTS)).cast("int"))
    other = listed(_alike(rectangles, [f"r_{c}" for c in sides], "_b"), "r_", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = own.join(other.hint("merge"), ["_cx", "_cy", "_part"])
    met = met.where("left <= r_right and r_left <= right and bottom <= r_top and r_bottom <= top")
    first = (F.col("_cx") == F.floor(F.greatest("left", "r_left") / cell)) & (F.col("_cy") == F.floor(F.greatest("bottom", "r_bottom") / cell))
    pairs = met.where(first).withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b"))
    return pairs.select(*(F.col(c) if c in sides else F.col("_a")[c].alias(c) for c in boxes.columns), *(F.col(c) if c[2:] in sides and c.startswith("r_") else F.col("_b")[c].alias(c) for c in rectangles.columns))


def transformed(x: Column, y: Column, m: list) -> tuple[Column, Column]:
    """A point through the matrix [a b c d e f]: x' = a x + c y + e, y' = b x + d y + f."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def transformed_box(left: Column, bottom: Column, right: Column, top: Column, m: list) -> Column:
    """struct(left, bottom, right, top) around the four corners after the matrix."""
    corners = [transformed(x, y, m) for x in (left, right) for y in (bottom, top)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.struct(F.least(*xs).alias("left"), F.least(*ys).alias("bottom"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("top"))


def nearest(points: DataFrame, items: DataFrame, by: str, point_id: str, item_id: str) -> DataFrame:
    """point_id, item_id, distance: for each point (by, x, y) the item (by, left, bottom, right, top) of the same `by` (a page)
    with the smallest distance from it, 0 inside; of equally near ones the smaller item_id.

    Items with the same box count once, with their smallest id. A first pass over the pairs of a page finds each point's
    distance, a second one the smallest id at that distance: both keep one number a point in a hash table, where the least pair
    of distance and id would sort all pairs."""
    box = ["left", "bottom", "right", "top"]
    boxes = items.groupBy(by, *box).agg(F.min(item_id).alias("_item"))
    dx = F.greatest(F.col("left") - F.col("x"), F.col("x") - F.col("right"), F.lit(0.0))
    dy = F.greatest(F.col("bottom") - F.col("y"), F.col("y") - F.col("top"), F.lit(0.0))
    distance, point = F.sqrt(dx * dx + dy * dy), [point_id, by, "x", "y"]
    near = points.select(*point).repartition(point_id).join(boxes, by).groupBy(*point).agg(F.min(distance).alias("distance"))
    found = near.join(boxes, by).where(distance == F.col("distance")).groupBy(*point, "distance").agg(F.min("_item").alias(item_id))
    return found.groupBy(point_id).agg(F.min(F.struct("distance", item_id)).alias("b")).select(point_id, f"b.{item_id}", "b.distance")


def first_by_key(entries: DataFrame, key: str, order: str) -> DataFrame:
    """The first entry of each key in tree order; later ones of the same key don't count."""
    return entries.groupBy(key).agg(F.min_by(F.struct(*[c for c in entries.columns if c != key]), order).alias("_e")).select(key, "_e.*")


def page_by_label(labels: DataFrame, asked: DataFrame, label: str, page: str) -> DataFrame:
    """asked with page: the first page with exactly this label, else the first that differs in case alone, else null."""
    exact = labels.groupBy(F.col(label).alias("_l")).agg(F.min(page).alias("_exact"))
    loose = labels.groupBy(F.lower(label).alias("_u")).agg(F.min(page).alias("_loose"))
    out = asked.join(exact, F.col("asked") == F.col("_l"), "left").join(loose, F.lower("asked") == F.col("_u"), "left")
    return out.select(*asked.columns, F.coalesce("_exact", "_loose").alias(page))


def folder_of(name: Column) -> Column:
    """The folder id that a portfolio file's name begins with, such as <12>report.pdf; null without one."""
    return F.nullif(F.regexp_extract(name, "^<([0-9]+)>", 1), F.lit("")).cast("long")


def owned_attribute(own: Column, classes: Column, inherited: Column | None = None, default: Column | None = None) -> Column:
    """An attribute's value: the element's own, else the first of its classes', else the ancestors', else the default."""
    out = [own, F.get(F.filter(classes, lambda x: x.isNotNull()), F.lit(0))]
    return F.coalesce(*out, *([inherited] if inherited is not None else []), *([default] if default is not None else []))


def required_version(rows: DataFrame, key: str, feature: str, needs: dict[str, str], floor: str) -> DataFrame:
    """key, version, feature: the highest version that the features of a key need, not below floor; of features that need the
    same the first by name; null where the floor alone counts."""
    known = F.create_map(*[F.lit(x) for kv in needs.items() for x in kv])
    each = rows.select(key, F.col(feature).alias("f"), F.element_at(known, F.col(feature)).alias("v")).where("v is not null")
    best = each.groupBy(key, "v").agg(F.min("f").alias("f")).groupBy(key).agg(F.max(F.struct("v", "f")).alias("m"))
    out = rows.select(key).distinct().join(best, key, "left")
    above = F.col("m.v") > F.lit(floor)
    return out.select(key, F.when(above, F.col("m.v")).otherwise(F.lit(floor)).alias("version"), F.when(above, F.col("m.f")).alias("feature"))


def upper_median(rows: DataFrame, key: str, value: str, fallback: float | None = None) -> DataFrame:
    """key, median: the value at place floor(n / 2), counted from 0, in ascending order; fallback where it is 0 or less, or where
    a key has no value at all (without a fallback null).

    Two passes: approximate quantiles bound each key's middle thousandths, then only the distinct values in there are
    ordered, with counts of what lies below; a hot key costs partial aggregates, not one task."""
    known = rows.where(F.col(value).isNotNull())
    bounds = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, [0.499, 0.501], 20_000).alias("_b"))
    met = known.select(key, F.col(value).alias("_v")).join(F.broadcast(bounds) if bounds.limit(10_001).count() <= 10_000 else bounds, key)
    inside = (F.col("_v") >= F.col("_b")[0]) & (F.col("_v") <= F.col("_b")[1])
    counts = met.where((F.col("_v") <= F.col("_b")[1])).groupBy(key, F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(F.col("_v").asc_nulls_first()))
    placed = counts.withColumn("_upto", upto).where(F.col("_v").isNotNull() & (F.floor(F.col("_n") / 2) < F.col("_upto")) & (F.floor(F.col("_n") / 2) >= F.col("_upto") - F.col("_c")))
    found = rows.select(key).distinct().join(placed.select(key, "_v"), key, "left")
    out = F.col("_v") if fallback is None else F.when(F.col("_v") > 0, F.col("_v")).otherwise(F.lit(fallback))
    return found.select(key, out.alias("median"))


def mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, mode, n: the most frequent value, of equally frequent ones the smallest."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col(value))).alias("_m")).select(key, F.col(f"_m.{value}").alias("mode"), (-F.col("_m.col1")).alias("n"))


def placed(rows: DataFrame, by: list, name: str) -> DataFrame:
    """rows with their place from 1 in the order of `by`: dealt into ranges, numbered within each, and moved on by the counts of
    the ranges before, of which the driver gets one row each."""
    ranged = cut(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before, bases = 0, []
    for r in sorted(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        bases.append((r["_range"], before))
        before += r["n"]
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    known = F.broadcast(rows.sparkSession.createDataFrame(bases, "_range int, _base long"))
    return ranged.withColumn(name, own).join(known, "_range").withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_base")
