"""From glyph rows to words, lines, text and layout: filters, breaks, boxes, fragments, headings, tables' headers, captions.

Glyph rows have page (and document) keys, seq (content order), text, x and y (start on the baseline), advance, size, and flags.
A page's rows are bounded by the page, so windows and groups by page are spread by the number of pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN, ARTIFACT = 2, 4
WORD_GAP = 0.1
LINE_OFF, BACKTRACK = 0.5, 1.0


def wanted_glyphs(glyphs: DataFrame, hidden: bool = False, artifacts: bool = False) -> DataFrame:
    """Without hidden glyphs and artifacts unless they are asked for."""
    has = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    tests = [~has(HIDDEN)] * (not hidden) + [~has(ARTIFACT)] * (not artifacts)
    return glyphs.where(reduce(lambda a, b: a & b, tests)) if tests else glyphs


def in_reading_order(glyphs: DataFrame, keys: list[str], order: str = "Structure") -> DataFrame:
    """glyphs with position, from 0 on each page: by structure (rank of the element, then content order; glyphs without an
    element behind all others) or by content."""
    by = [F.col("rank").asc_nulls_last(), "seq"] if order == "Structure" else ["seq"]
    return glyphs.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)


def replaced(glyphs: DataFrame, keys: list[str], group: str, replacement: str) -> DataFrame:
    """glyphs with the text of a replacement: of the glyphs of a group that has one the first carries it and the others are
    empty; a group without glyphs adds nothing."""
    first = F.row_number().over(Window.partitionBy(*keys, group).orderBy("seq")) == 1
    has = F.col(group).isNotNull() & F.col(replacement).isNotNull()
    return glyphs.withColumn("text", F.when(has & first, F.col(replacement)).when(has, "").otherwise(F.col("text")))


def inside_crop(rows: DataFrame, left: Column, bottom: Column, right: Column, top: Column) -> DataFrame:
    """Rows whose box (left, bottom, right, top) reaches into the crop box; one that only touches its edge is outside."""
    return rows.where((F.col("left") < right) & (F.col("right") > left) & (F.col("bottom") < top) & (F.col("top") > bottom))


def numbered_lines(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """glyphs with line: a new one begins where a glyph's baseline is more than half an em off the one of its line's first glyph,
    or it starts more than an em before the end of the one before. What a line's first glyph is depends on all breaks before,
    so a fold over the page's ordered glyphs decides; super- and subscripts stay on their line.

    Glyphs go through the fold whole: a join of them with their numbers would count as small as the table they came from, and
    Spark would send it to the driver for a broadcast."""
    first = ["seq", "x", "y", "advance", "size"]
    rest = [c for c in glyphs.columns if c not in (*keys, *first)]
    one = F.struct(F.lit(0).alias("line"), F.lit(None).cast("double").alias("anchor"), F.lit(None).cast("double").alias("end"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, g: Column) -> Column:
        new = F.coalesce((F.abs(g["y"] - s["anchor"]) > g["size"] * LINE_OFF) | (g["x"] < s["end"] - g["size"] * BACKTRACK), F.lit(False))
        line = s["line"] + F.when(new, 1).otherwise(0)
        anchor = F.when(new | s["anchor"].isNull(), g["y"]).otherwise(s["anchor"])
        return F.struct(line.alias("line"), anchor.alias("anchor"), (g["x"] + g["advance"]).alias("end"), F.concat(s["out"], F.array(line)).alias("out"))

    pages = glyphs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*first, *rest))).alias("_g"))
    numbers = pages.select(*keys, "_g", F.aggregate("_g", one, step, lambda s: s["out"]).alias("_line"))
    out = numbers.select(*keys, F.explode(F.arrays_zip("_g", "_line")).alias("_z"))
    return out.select(*[c if c in keys else F.col("_z._g")[c].alias(c) for c in glyphs.columns], F.col("_z._line").alias("line"))


def words(glyphs: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys, line, word (from 0 on each line), text, left, right, baseline, size: glyphs of a line parted where the gap is wider
    than a tenth of an em, and at blanks, which belong to no word."""
    order = Window.partitionBy(*keys, line).orderBy("seq")
    blank = F.col("text").rlike("^[\\s\\p{Z}]+$")
    gap = F.col("x") - F.lag(F.col("x") + F.col("advance")).over(order)
    starts = F.coalesce((gap > F.col("size") * WORD_GAP) | F.lag(blank).over(order), F.lit(True)) & ~blank
    marked = glyphs.withColumn("_blank", blank).withColumn("_starts", starts)
    marked = marked.withColumn("word", F.sum(F.col("_starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("not _blank")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda g: g["text"]), "")
    return marked.groupBy(*keys, line, "word").agg(text.alias("text"), F.min("x").alias("left"), F.max(F.col("x") + F.col("advance")).alias("right"), F.min_by("y", "seq").alias("baseline"), F.max("size").alias("size"))


def plain_text(found: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys, text: words joined by one blank, lines by one line feed."""
    lines = found.groupBy(*keys, line).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(line, "text"))), lambda w: w["text"]), "\n").alias("text"))


def oriented_box(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and, in the frame of the first glyph of each group (its baseline's angle in degrees), along0, along1, across0,
    across1 around all glyphs of the group (x, y, advance, ascent, descent, angle)."""
    order = Window.partitionBy(*keys).orderBy("seq")
    framed = glyphs.withColumn("_a", F.radians(F.first("angle").over(order)))
    along = lambda x, y: x * F.cos("_a") + y * F.sin("_a")
    across = lambda x, y: y * F.cos("_a") - x * F.sin("_a")
    own = F.radians("angle")
    corners = []
    for step in (F.lit(0.0), F.col("advance")):
        for rise in (F.col("descent"), F.col("ascent")):
            corners.append((F.col("x") + step * F.cos(own) - rise * F.sin(own), F.col("y") + step * F.sin(own) + rise * F.cos(own)))
    low = lambda f: F.least(*[f(x, y) for x, y in corners])
    high = lambda f: F.greatest(*[f(x, y) for x, y in corners])
    return framed.groupBy(*keys).agg(F.min(low(along)).alias("along0"), F.max(high(along)).alias("along1"), F.min(low(across)).alias("across0"), F.max(high(across)).alias("across1"))


def fragments(found: DataFrame, keys: list[str], line: str = "line", rules: DataFrame | None = None) -> DataFrame:
    """keys, line, fragment, left, right, n_words, text: the words of a line parted where the gap to all words before is wider than
    1.5 times the line's height, or where a vertical rule (keys, line, at) crosses it."""
    order = Window.partitionBy(*keys, line).orderBy("left", "word")
    height = F.max("size").over(Window.partitionBy(*keys, line))
    reached = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_reached", reached).withColumn("_new", F.coalesce(F.col("left") - reached > 1.5 * height, F.lit(False)))
    if rules is not None:
        crossed = rows.join(rules, [*keys, line]).where("at > _reached and at < left").select(*keys, line, "word").distinct().withColumn("_crossed", F.lit(True))
        rows = rows.join(crossed, [*keys, line, "word"], "left").withColumn("_new", F.col("_new") | F.coalesce("_crossed", F.lit(False)))
    rows = rows.withColumn("fragment", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "word", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy(*keys, line, "fragment").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count(F.lit(1)).alias("n_words"), text.alias("text"))


def gaps_below(boxes: DataFrame, keys: list[str], box: str) -> DataFrame:
    """keys, box, gap: the gap from each box to the nearest one below it that it overlaps sideways, within three heights of it;
    boxes without one are left out."""
    a = boxes.select(*keys, F.col(box), "left", "right", "bottom", (F.col("top") - F.col("bottom")).alias("height"))
    b = boxes.select(*keys, F.col("left").alias("_l"), F.col("right").alias("_r"), F.col("top").alias("_t"))
    met = a.join(b, keys).where("_l < right and left < _r and _t <= bottom and bottom - _t <= 3 * height")
    return met.groupBy(*keys, box).agg(F.min(F.col("bottom") - F.col("_t")).alias("gap"))


def rows_of_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """boxes with row, from 0 downwards: in the order of their tops a box joins the row before it if it overlaps that row's
    reach by half of its own height or more."""
    order = Window.partitionBy(*keys).orderBy(F.col("top").desc(), "left", "box")
    reach = F.min("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("top") - reach < 0.5 * (F.col("top") - F.col("bottom")), F.lit(False))
    return boxes.withColumn("_new", new).withColumn("row", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def headings(blocks: DataFrame, doc: str) -> DataFrame:
    """blocks (size, bold, n_glyphs, n_rows, n_letters, share, text) of a document with level, null for body text.

    The body's style is the one with most glyphs, of equal ones the smaller, then the one that isn't bold. A heading is 1.15 times
    as large on three rows at most, or bold where the body isn't on two rows at most without a full stop at the end; it has two
    letters or more, doesn't end in a colon, has 60 % of its glyphs in one style and 200 glyphs at most. Levels rank the
    headings' styles, largest first, then bold."""
    styles = blocks.groupBy(doc, "size", "bold").agg(F.sum("n_glyphs").alias("_g"))
    body = styles.groupBy(doc).agg(F.max(F.struct("_g", (-F.col("size")).alias("s"), (~F.col("bold")).alias("b"))).alias("m")).select(doc, (-F.col("m.s")).alias("_size"), (~F.col("m.b")).alias("_bold"))
    met = blocks.join(body, doc)
    large = (F.col("size") >= 1.15 * F.col("_size")) & (F.col("n_rows") <= 3)
    bold = F.col("bold") & ~F.col("_bold") & (F.col("size") >= F.col("_size")) & (F.col("n_rows") <= 2) & ~F.col("text").endswith(".")
    is_one = (large | bold) & (F.col("n_letters") >= 2) & ~F.col("text").endswith(":") & (F.col("share") >= 0.6) & (F.col("n_glyphs") <= 200)
    met = met.withColumn("_is", is_one)
    levels = met.where("_is").select(doc, "size", "bold").distinct()
    levels = levels.withColumn("level", F.dense_rank().over(Window.partitionBy(doc).orderBy(F.col("size").desc(), F.col("bold").desc())))
    out = met.join(levels, [doc, "size", "bold"], "left")
    return out.select(*blocks.columns, F.when(F.col("_is"), F.col("level")).alias("level"))


def header_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (row, col, col_span, text, bold) with is_header. Header rows are the leading ones, never the last, that have a filled
    spanning cell or are all bold over some plain cell; if there is none, the first row if it has letters and no number and some
    column below has two filled cells or more, 60 % of them numbers.

    One shuffle by table and windows over it, no join: Spark takes exploded cells for as small as the rows they came from, and
    would send them to the driver for a broadcast."""
    filled, number = F.col("text") != "", F.col("text").rlike("^[\\s(+-]*[$\u20ac\u00a3]?[\\d.,]+[%)]?\\s*$")
    table, row, column = Window.partitionBy(*keys), Window.partitionBy(*keys, "row"), Window.partitionBy(*keys, "col")
    down = table.orderBy("row")
    marks = {"_spans": F.max(filled & (F.col("col_span") > 1)), "_bold": F.min(F.col("bold") | ~filled), "_plain": F.max(filled & ~F.col("bold")), "_letters": F.max(filled & F.col("text").rlike("\\p{L}")), "_numbers": F.max(filled & number)}
    by_row = cells.repartition(*keys).withColumns({k: v.over(row) for k, v in marks.items()})
    below = F.max("_plain").over(down.rangeBetween(1, Window.unboundedFollowing))
    by_row = by_row.withColumns({"_below": below, "_last": F.max("row").over(table)})
    by_row = by_row.withColumn("_may", (F.col("row") < F.col("_last")) & (F.col("_spans") | (F.col("_bold") & F.coalesce("_below", F.lit(False)))))
    by_row = by_row.withColumn("_leads", F.min("_may").over(down.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_any", F.max("_leads").over(table))
    inner = lambda what: F.sum(F.when(F.col("row") > 0, what.cast("int"))).over(column)
    by_col = by_row.withColumns({"_n": inner(filled), "_k": inner(filled & number)})
    by_col = by_col.withColumn("_numeric", F.max((F.col("_n") >= 2) & (F.col("_k") >= 0.6 * F.col("_n"))).over(table))
    first = (F.col("row") == 0) & (F.col("row") < F.col("_last")) & F.col("_letters") & ~F.col("_numbers") & F.coalesce("_numeric", F.lit(False))
    return by_col.select(*cells.columns, F.when(F.col("_any"), F.col("_leads")).otherwise(first).alias("is_header"))


def cell_headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, headers: of each data cell the texts of the filled header cells over its column, from the top. Header cells
    are listed under the columns that they span, and each column is read downwards."""
    under = F.when(F.col("is_header") & (F.col("text") != ""), F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).when(~F.col("is_header"), F.array("col"))
    listed = cells.select(*keys, "row", "text", "is_header", F.explode(under).alias("col"))
    above = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(Window.unboundedPreceding, -1)
    heads = F.sort_array(F.collect_list(F.when(F.col("is_header"), F.struct("row", "text"))).over(above))
    return listed.select(*keys, "row", "col", "is_header", F.transform(heads, lambda h: h["text"]).alias("headers")).where("not is_header").drop("is_header")


def linked_tables(tables: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, page, next_page of tables (page, is_first, is_last on its page, height, edges) that go on: one that ends a page and one that
    begins the next, with as many columns and every column's edge within twice the larger height."""
    a = tables.where("is_last").select(doc, page, F.col("edges").alias("a"), F.col("height").alias("h"))
    b = tables.where("is_first").select(doc, (F.col(page) - 1).alias(page), F.col("edges").alias("b"), F.col("height").alias("k"))
    near = F.forall(F.arrays_zip("a", "b"), lambda e: F.abs(e["a"] - e["b"]) <= 2 * F.greatest("h", "k"))
    return a.join(b, [doc, page]).where((F.size("a") == F.size("b")) & near).select(doc, page, (F.col(page) + 1).alias("next_page"))


def captions(targets: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, label: each target (kind Figure or Table, height, left, bottom, right, top) with the label (a caption's
    box) that suits it: within five heights, half overlapped sideways; the score is the distance, and half a height more on
    the side that isn't preferred (below for figures, above for tables). Best pairs go first, each box once: a pair counts
    if no better pair has its target or its label, found in rounds on the page's pairs."""
    t = targets.select(*keys, "target", "kind", "height", "left", "bottom", "right", "top")
    c = labels.select(*keys, "label", *(F.col(x).alias(f"c_{x}") for x in ("left", "bottom", "right", "top")))
    above, below = F.col("c_bottom") - F.col("top"), F.col("bottom") - F.col("c_top")
    distance = F.greatest(above, below)
    met = t.join(c, keys)
    shared = F.least("right", "c_right") - F.greatest("left", "c_left")
    liked = F.when(F.col("kind") == "Figure", below >= above).otherwise(above >= below)
    score = distance + F.when(liked, 0.0).otherwise(0.5 * F.col("height"))
    pairs = met.where((distance >= -0.5 * F.col("height")) & (distance <= 5 * F.col("height")) & (shared >= 0.5 * F.least(F.col("right") - F.col("left"), F.col("c_right") - F.col("c_left"))))
    pairs = pairs.select(*keys, F.struct(score.alias("s"), F.col("target"), F.col("label")).alias("p"))
    one = F.struct(F.array().cast("array<bigint>").alias("t"), F.array().cast("array<bigint>").alias("l"))

    def step(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["t"], p["target"]) & ~F.array_contains(s["l"], p["label"])
        return F.struct(F.when(free, F.concat(s["t"], F.array(p["target"]))).otherwise(s["t"]).alias("t"), F.when(free, F.concat(s["l"], F.array(p["label"]))).otherwise(s["l"]).alias("l"))

    taken = pairs.groupBy(*keys).agg(F.aggregate(F.sort_array(F.collect_list("p")), one, step).alias("g"))
    return taken.select(*keys, F.explode(F.arrays_zip("g.t", "g.l")).alias("z")).select(*keys, F.col("z.t").alias("target"), F.col("z.l").alias("label"))


def word_range(text: Column, at: Column) -> Column:
    """struct(start, beyond) of the word around a place (from 0) of one line: a run of letters and digits or of blanks, or one
    mark alone."""
    kind = lambda c: F.when(c.rlike("^[\\p{L}\\p{Nd}\\p{Mn}\\p{Mc}]$"), "w").when(c.rlike("^[\\s\\p{Z}]$"), "b").otherwise("p")
    here = kind(F.substring(text, at + 1, F.lit(1)))
    word, blank = "[\\p{L}\\p{Nd}\\p{Mn}\\p{Mc}]", "[\\s\\p{Z}]"
    before, behind = F.substring(text, F.lit(1), at), F.substring(text, at + 2, F.length(text))
    back = F.when(here == "w", F.length(F.regexp_extract(before, f"{word}+$", 0))).when(here == "b", F.length(F.regexp_extract(before, f"{blank}+$", 0))).otherwise(0)
    on = F.when(here == "w", F.length(F.regexp_extract(behind, f"^{word}+", 0))).when(here == "b", F.length(F.regexp_extract(behind, f"^{blank}+", 0))).otherwise(0)
    return F.struct((at - back).alias("start"), (at + 1 + on).alias("beyond"))
