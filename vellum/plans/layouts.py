"""Queries from glyph rows to words, lines and layout, and the SQL that gives the same rows.

Glyphs are the characters of part names: a name is a line, a brand a document, ten parts of it a page. A character is half an em
wide, blanks are left out (the gap tells words apart) or kept, and names are set at sizes by p_size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import layout
from vellum.plans.base import query
from vellum.session import table


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, line, seq, text, x, y, advance, size, flags: every 11th glyph is hidden, names of parts that 13 divides are artifacts."""
    size = F.lit(10.0)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey"), F.floor(F.col("p_partkey") / 10).alias("page"), (F.col("p_partkey") % 10).cast("int").alias("own"), F.posexplode(F.split("p_name", "")).alias("k", "text"))
    flags = F.when(F.col("k") % 11 == 10, 2).otherwise(0) + F.when(F.col("p_partkey") % 13 == 0, 4).otherwise(0)
    # A third of the parts have a superscript: characters raised by a fifth of an em.
    y = 800.0 - 14.0 * F.col("own") + F.when((F.col("p_partkey") % 3 == 0) & (F.col("k") % 5 == 4), 0.2 * size).otherwise(0.0)
    return part.select("page", "p_partkey", "own", (F.col("own") * 1000 + F.col("k")).cast("long").alias("seq"), "text", (50.0 + 5.0 * F.col("k")).alias("x"), y.alias("y"), F.lit(5.0).alias("advance"), size.alias("size"), flags.alias("flags"))


_WORDS = "list_filter(string_split(p_name, ' '), lambda w: w <> '')"


@query(f"""SELECT p_partkey // 10 AS page, CAST(p_partkey % 10 - min(p_partkey % 10) OVER (PARTITION BY p_partkey // 10) AS INT) AS line, CAST(k - 1 AS INT) AS word, {_WORDS}[k] AS text FROM (SELECT *, unnest(range(1, len({_WORDS}) + 1)) AS k FROM part)""")
def words_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-04, TXT-05, WIN-01: lines and words of glyphs, blanks left out; superscripts stay on their line."""
    glyphs = _glyphs(spark, sf_dir).where("text <> ' '")
    return layout.words(layout.numbered_lines(glyphs, ["page"]), ["page"]).select("page", F.col("line").cast("int").alias("line"), F.col("word").cast("int").alias("word"), "text")


@query(f"""SELECT p_partkey // 10 AS page, string_agg(array_to_string({_WORDS}, ' '), chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-06, TXT-10: plain text of pages from glyphs, blanks among them: words joined by a blank, lines by a line feed."""
    found = layout.words(layout.numbered_lines(_glyphs(spark, sf_dir), ["page"]), ["page"])
    return layout.plain_text(found, ["page"])


_SHOWN = "list_filter(list_transform(range(0, length(p_name)), lambda k: CASE WHEN k % 11 = 10 THEN '' ELSE substring(p_name, CAST(k + 1 AS INT), 1) END), lambda c: true)"


@query(f"""SELECT p_partkey, array_to_string({_SHOWN}, '') AS shown, p_name AS every, p_partkey % 13 = 0 AS artifact FROM part""")
def glyph_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-02, FLT-03: glyphs without the hidden ones, artifacts too (as asked), and all of them."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda g: g["text"]), "")
    g = _glyphs(spark, sf_dir)
    shown = layout.wanted_glyphs(g, artifacts=True).groupBy("p_partkey").agg(joined.alias("shown"))
    every = layout.wanted_glyphs(g, hidden=True, artifacts=True).groupBy("p_partkey").agg(joined.alias("every"))
    plain = layout.wanted_glyphs(g, hidden=True).select("p_partkey").distinct().withColumn("artifact", F.lit(False))
    return shown.join(every, "p_partkey").join(plain, "p_partkey", "left").withColumn("artifact", F.coalesce("artifact", F.lit(True)))


@query("""WITH g AS (SELECT l_suppkey AS page, (l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey AS seq, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_partkey % 20 END AS rank FROM lineitem)
    SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY rank NULLS LAST, seq) - 1 AS by_structure, row_number() OVER (PARTITION BY page ORDER BY seq) - 1 AS by_content FROM g""")
def reading_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, TXT-08, SEA-14, EXT-04: glyphs (line items) of a page in the order of their elements, and in content order."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_003 + F.col("l_partkey")).alias("seq"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey") % 20).alias("rank"))
    both = layout.in_reading_order(g, ["page"]).withColumnRenamed("position", "by_structure")
    return layout.in_reading_order(both, ["page"], "Content").select("page", "seq", "by_structure", F.col("position").alias("by_content"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type || substring(p_name, 6) WHEN p_partkey % 4 = 1 THEN substring(p_name, 1, 5) || upper(p_brand) || substring(p_name, 11) ELSE p_name END AS text FROM part""")
def replaced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, FLT-06: the first or the second five glyphs of a name are an element with a replacement; its first glyph carries it."""
    part = table(spark, sf_dir, "part")
    g = part.select("p_partkey", "p_type", "p_brand", F.posexplode(F.split("p_name", "")).alias("seq", "text"))
    k = F.col("p_partkey") % 4
    g = g.withColumn("element", F.when((k == 0) & (F.col("seq") < 5), 0).when((k == 1) & F.col("seq").between(5, 9), 1))
    g = layout.replaced(g.withColumn("instead", F.when(k == 0, F.col("p_type")).otherwise(F.upper("p_brand"))), ["p_partkey"], "element", "instead")
    return g.groupBy("p_partkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))


@query("""WITH g AS (SELECT s_nationkey AS run, s_suppkey AS seq, s_suppkey % 17 * 3.0 AS x, s_suppkey % 5 * 2.0 AS y, 4.0 AS advance, s_nationkey * 15.0 AS angle FROM supplier), f AS (SELECT *, radians(angle) AS a FROM g),
    c AS (SELECT run, a, x + s * cos(a) - r * sin(a) AS cx, y + s * sin(a) + r * cos(a) AS cy FROM f CROSS JOIN (VALUES (0, -2.0), (0, 8.0), (4.0, -2.0), (4.0, 8.0)) t(s, r))
    SELECT run, round(min(cx * cos(a) + cy * sin(a)), 6) AS along0, round(max(cx * cos(a) + cy * sin(a)), 6) AS along1, round(min(cy * cos(a) - cx * sin(a)), 6) AS across0, round(max(cy * cos(a) - cx * sin(a)), 6) AS across1 FROM c GROUP BY run""")
def oriented_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-07: boxes of runs of turned glyphs in the frame of their first glyph."""
    g = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS run", "s_suppkey AS seq", "s_suppkey % 17 * 3.0D AS x", "s_suppkey % 5 * 2.0D AS y", "4.0D AS advance", "8.0D AS ascent", "-2.0D AS descent", "s_nationkey * 15.0D AS angle")
    return layout.oriented_box(g, ["run"]).select("run", *(F.round(c, 6).alias(c) for c in ("along0", "along1", "across0", "across1")))


@query("""WITH w AS (SELECT l_suppkey AS page, l_partkey % 5 AS line, (l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey AS word, l_quantity * 10 + l_linenumber * 600 AS l, l_quantity * 10 + l_linenumber * 600 + 20 AS r, l_returnflag AS t FROM lineitem),
    f AS (SELECT *, l - max(r) OVER (PARTITION BY page, line ORDER BY l, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 15 AS n FROM w),
    k AS (SELECT *, sum(coalesce(n, false)::INT) OVER (PARTITION BY page, line ORDER BY l, word ROWS UNBOUNDED PRECEDING) AS fragment FROM f)
    SELECT page, line, CAST(fragment AS BIGINT) AS fragment, min(l) AS "left", max(r) AS "right", count(*) AS n_words, string_agg(t, ' ' ORDER BY l, word) AS text FROM k GROUP BY page, line, fragment""")
def line_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-01: words (line items) of lines parted at wide gaps."""
    w = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS page", "l_partkey % 5 AS line", "(l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey AS word", "l_quantity * 10 + l_linenumber * 600 AS left", "l_quantity * 10 + l_linenumber * 600 + 20 AS right", "10.0D AS size", "l_returnflag AS text")
    return layout.fragments(w, ["page"]).withColumn("fragment", F.col("fragment").cast("long"))


@query("""WITH b AS (SELECT p_partkey // 20 AS page, p_partkey AS box, p_size AS l, p_size + 12 AS r, p_partkey % 20 * 9 AS bo, p_partkey % 20 * 9 + 6 AS t FROM part),
    g AS (SELECT a.page, a.box, min(a.bo - b.t) AS gap FROM b a JOIN b ON a.page = b.page AND b.l < a.r AND a.l < b.r AND b.t <= a.bo AND a.bo - b.t <= 18 GROUP BY 1, 2)
    SELECT page, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS gap FROM g GROUP BY page""")
def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-03: the upper median of the gaps from boxes to the nearest one below that they overlap sideways."""
    from vellum.operators import lookups

    b = table(spark, sf_dir, "part").selectExpr("CAST(floor(p_partkey / 20) AS BIGINT) AS page", "p_partkey AS box", "p_size AS left", "p_size + 12 AS right", "p_partkey % 20 * 9 AS bottom", "p_partkey % 20 * 9 + 6 AS top")
    return lookups.upper_median(layout.gaps_below(b, ["page"], "box"), "page", "gap").withColumnRenamed("median", "gap")


@query("""WITH b AS (SELECT p_partkey // 10 AS page, p_partkey AS box, p_retailprice * 2 AS t, p_retailprice * 2 - p_size - 5 AS bo, p_size + 5 AS h FROM part),
    f AS (SELECT *, t - min(bo) OVER (PARTITION BY page ORDER BY t DESC, h, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.5 * h AS n FROM b)
    SELECT page, box, sum(coalesce(n, false)::INT) OVER (PARTITION BY page ORDER BY t DESC, h, box ROWS UNBOUNDED PRECEDING)::BIGINT AS "row" FROM f""")
def rows_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-05 (rows): boxes that overlap a row by half of their height join it."""
    b = table(spark, sf_dir, "part").selectExpr("CAST(floor(p_partkey / 10) AS BIGINT) AS page", "p_partkey AS box", "p_size + 5 AS left", "p_retailprice * 2 AS top", "p_retailprice * 2 - p_size - 5 AS bottom")
    return layout.rows_of_boxes(b, ["page"]).select("page", "box", F.col("row").cast("long").alias("row"))


@query("""WITH b AS (SELECT p_brand AS doc, p_partkey, 8 + p_size % 9 AS size, p_partkey % 3 = 0 AS bold, length(p_name) AS n, p_partkey % 4 + 1 AS n_rows, CASE WHEN p_partkey % 7 = 0 THEN p_name || ':' WHEN p_partkey % 5 = 0 THEN p_name || '.' ELSE p_name END AS text, p_partkey % 10 / 10 AS share FROM part),
    s AS (SELECT doc, size, bold, sum(n) AS g FROM b GROUP BY ALL), m AS (SELECT doc, size AS bs, bold AS bb FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY g DESC, size, bold) = 1),
    h AS (SELECT b.*, ((size >= 1.15 * bs AND n_rows <= 3) OR (bold AND NOT bb AND size >= bs AND n_rows <= 2 AND NOT ends_with(text, '.'))) AND n >= 2 AND NOT ends_with(text, ':') AND share >= 0.6 AND n <= 200 AS is_one FROM b JOIN m USING (doc)),
    r AS (SELECT doc, size, bold, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC, bold DESC) AS level FROM (SELECT DISTINCT doc, size, bold FROM h WHERE is_one))
    SELECT doc, p_partkey, CASE WHEN is_one THEN CAST(level AS INT) END AS level FROM h LEFT JOIN r USING (doc, size, bold)""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-10: blocks (parts) of documents (brands) with sizes, weights and rows; headings and their levels."""
    b = table(spark, sf_dir, "part").selectExpr(
        "p_brand AS doc", "p_partkey", "8 + p_size % 9 AS size", "p_partkey % 3 = 0 AS bold", "CAST(length(p_name) AS BIGINT) AS n_glyphs", "p_partkey % 4 + 1 AS n_rows", "length(p_name) AS n_letters",
        "CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, ':') WHEN p_partkey % 5 = 0 THEN concat(p_name, '.') ELSE p_name END AS text", "p_partkey % 10 / 10D AS share",
    )
    return layout.headings(b, "doc").select("doc", "p_partkey", "level")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of three kinds by part: with a spanning cell, with a bold row, and with words over numbers."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 4).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row"))
    part = part.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col")).where("not (kind = 0 and row = 0 and col = 2)")
    text = F.when(F.col("row") == 0, F.concat(F.lit("h"), F.col("col").cast("string"))).when((F.col("kind") == 0) & (F.col("row") == 1), F.concat(F.lit("s"), F.col("col").cast("string")))
    text = text.when(F.col("kind") == 3, F.lit("word")).otherwise((F.col("p_size") * F.col("row")).cast("string"))
    return part.select("p_partkey", "kind", "row", "col", F.when((F.col("kind") == 0) & (F.col("row") == 0) & (F.col("col") == 1), 2).otherwise(1).alias("col_span"), text.alias("text"), ((F.col("kind") == 1) & (F.col("row") == 0)).alias("bold"))


@query("""SELECT p_partkey, "row", col, CASE WHEN p_partkey % 4 = 3 THEN [] WHEN p_partkey % 4 = 0 AND col > 0 THEN ['h1'] ELSE ['h' || col] END AS headers FROM part CROSS JOIN (VALUES (0), (1), (2), (3)) r("row") CROSS JOIN (VALUES (0), (1), (2)) c(col)
    WHERE CASE WHEN p_partkey % 4 = 3 THEN true ELSE "row" > 0 END""")
def cell_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-08, JON-12: header rows by a spanning cell, by weight, and by words over numbers; the headers of each data cell."""
    return layout.cell_headers(layout.header_rows(_cells(spark, sf_dir), ["p_partkey"]), ["p_partkey"])


@query("""WITH t AS (SELECT s_nationkey AS doc, s_suppkey AS page, [s_suppkey % 3 * 4.0, 100.0 + s_suppkey % 2, 200.0] AS e, 5.0 AS h, s_suppkey % 5 <> 0 AS f, s_suppkey % 7 <> 0 AS z, s_suppkey % 11 = 0 AS short FROM supplier),
    u AS (SELECT *, CASE WHEN short THEN e[1:2] ELSE e END AS edges FROM t)
    SELECT a.doc, a.page, a.page + 1 AS next_page FROM u a JOIN u b ON a.doc = b.doc AND b.page = a.page + 1 WHERE a.z AND b.f AND len(a.edges) = len(b.edges) AND list_bool_and(list_transform(range(1, len(a.edges) + 1), lambda k: abs(a.edges[k] - b.edges[k]) <= 10))""")
def linked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-09: tables that go on on the next page; documents are nations, pages suppliers."""
    edges = F.expr("array(s_suppkey % 3 * 4.0D, 100.0D + s_suppkey % 2, 200.0D)")
    t = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("page"), F.when(F.col("s_suppkey") % 11 == 0, F.slice(edges, 1, 2)).otherwise(edges).alias("edges"), F.lit(5.0).alias("height"),
        (F.col("s_suppkey") % 5 != 0).alias("is_first"), (F.col("s_suppkey") % 7 != 0).alias("is_last"),
    )
    return layout.linked_tables(t, "doc", "page")


@query("""SELECT p_partkey AS page, t AS target, CASE WHEN p_partkey % 2 = 0 THEN t + 10 ELSE t + 20 END AS label FROM part CROSS JOIN (VALUES (1), (2)) x(t) WHERE p_partkey % 5 <> 0 OR t = 1""")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-13: two figures or tables of a page (part), each with labels above and below; figures take the one below, tables the one
    above, and on some pages the second has none near."""
    page = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.explode(F.expr("array(1L, 2L)")).alias("t"))
    base = 1000 - 300 * F.col("t")
    targets = page.select("page", F.col("t").alias("target"), F.when(F.col("page") % 2 == 0, "Figure").otherwise("Table").alias("kind"), F.lit(10.0).alias("height"), F.lit(100).alias("left"), F.lit(300).alias("right"), base.alias("bottom"), (base + 100).alias("top"))
    side = F.explode(F.array(F.lit(1), F.lit(2)))
    c = page.where("page % 5 <> 0 or t = 1").select("page", "t", side.alias("side"), base.alias("base"))
    low = F.when(F.col("side") == 1, F.col("base") - 20).otherwise(F.col("base") + 110)
    labels = c.select("page", (F.col("t") + 10 * F.col("side")).alias("label"), F.lit(90).alias("left"), F.lit(250).alias("right"), low.alias("bottom"), (low + 10).alias("top"))
    return layout.captions(targets, labels, ["page"])


@query(r"""WITH l AS (SELECT p_partkey, concat(p_name, '; (', p_brand, ')') AS line, CAST(p_partkey % 20 AS INT) AS place FROM part)
    SELECT p_partkey, place AS "at", CAST(CASE WHEN regexp_matches(substring(line, place + 1, 1), '[\p{L}\p{Nd}]') THEN place - length(regexp_extract(substring(line, 1, place), '[\p{L}\p{Nd}]+$')) WHEN substring(line, place + 1, 1) = ' ' THEN place - length(regexp_extract(substring(line, 1, place), ' +$')) ELSE place END AS INT) AS start,
    CAST(CASE WHEN regexp_matches(substring(line, place + 1, 1), '[\p{L}\p{Nd}]') THEN place + length(regexp_extract(substring(line, place + 1), '^[\p{L}\p{Nd}]+')) WHEN substring(line, place + 1, 1) = ' ' THEN place + length(regexp_extract(substring(line, place + 1), '^ +')) ELSE place + 1 END AS INT) AS beyond FROM l""")
def word_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-11: the word around a place of a line: letters and digits, blanks, or a mark alone."""
    line, at = F.concat("p_name", F.lit("; ("), "p_brand", F.lit(")")), (F.col("p_partkey") % 20).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", at.alias("at"), layout.word_range(line, at).alias("r")).select("p_partkey", "at", "r.*")


@query("""SELECT conv_id, string_agg(substring(text, CASE WHEN turn = 1 THEN 4 ELSE 1 END, CASE WHEN turn = 3 THEN 10 ELSE 1000000 END), chr(10) ORDER BY turn) AS text FROM conversations WHERE turn BETWEEN 1 AND 3 GROUP BY conv_id""")
def range_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-12: the text from a place in the second line (turn) of each conversation to one in the fourth; lines joined by a line feed."""
    c = table(spark, sf_dir, "conversations").where(F.col("turn").between(1, 3))
    own = F.substring(F.col("text"), F.when(F.col("turn") == 1, 4).otherwise(1), F.when(F.col("turn") == 3, 10).otherwise(1_000_000))
    lines = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", own.alias("own")))).alias("l"))
    return lines.select("conv_id", F.array_join(F.transform("l", lambda x: x["own"]), "\n").alias("text"))


@query(r"""WITH m AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), k AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, length(line) AS n FROM m WHERE contains(lower(strip_accents(line)), 'the'))
    SELECT doc_id, line_no, 50 AS "left", 50 + 5 * n AS "right" FROM k""")
def match_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-07: the boxes of lines that hold a match; lines are runs of glyphs five wide from 50 on."""
    from vellum.functions.text import folded

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(folded(F.col("line")).contains("the"))
    return lines.select("doc_id", "line_no", F.lit(50).alias("left"), (50 + 5 * F.length("line")).alias("right"))


@query("""SELECT p_partkey // 20 AS page, p_partkey, CAST(dense_rank() OVER (PARTITION BY p_partkey // 20 ORDER BY CASE WHEN p_partkey % 20 = 0 THEN 0 WHEN p_partkey % 20 < 10 THEN 1 ELSE 2 END) - 1 AS INT) AS block FROM part""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-04: twenty parts a page: a heading over two columns of lines; blocks in reading order."""
    from vellum.operators import blocks

    k = F.col("p_partkey") % 20
    row = F.when(k < 10, k).otherwise(k - 9)
    rows = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 20).alias("page"), "p_partkey", F.when(k < 10, 50.0).otherwise(320.0).alias("left"), F.when(k == 0, 560.0).when(k < 10, 290.0).otherwise(560.0).alias("right"),
        F.when(k == 0, 790.0).otherwise(760.0 - 12.0 * row).alias("bottom"), F.when(k == 0, 806.0).otherwise(770.0 - 12.0 * row).alias("top"),
    )
    return blocks.blocks(rows, ["page"], line_gap=2.0, height=10.0).select("page", "p_partkey", F.col("block").cast("int").alias("block"))


_ITEMS = [("1.", 50.0), ("text", 50.0), ("2.", 50.0), ("(a)", 70.0), ("(b)", 70.0), ("3.", 50.0), ("•", 50.0), ("i)", 70.0), ("ii)", 70.0), ("word", 50.0)]


@query("SELECT c_custkey // 10 AS page, c_custkey AS seq, l.list, l.level FROM customer JOIN (VALUES (0, 0, 0), (2, 0, 0), (3, 1, 1), (4, 1, 1), (5, 0, 0), (6, 2, 0), (7, 3, 1), (8, 3, 1)) l(k, list, level) ON c_custkey % 10 = l.k WHERE c_custkey // 10 > 0 AND c_custkey // 10 < (SELECT max(c_custkey) // 10 FROM customer)")
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-11: ten lines a page (customers) with markers: a numbered list with a lettered one inside, a bullet with numerals inside;
    whole pages."""
    from vellum.operators import blocks

    at = (F.col("c_custkey") % 10 + 1).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    lines = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 10).alias("page"), F.col("c_custkey").alias("seq"), of([x for _, x in _ITEMS]).alias("left"), of([w for w, _ in _ITEMS]).alias("word"))
    last = lines.agg(F.max("page")).first()[0] or 0
    return blocks.lists(lines.where((F.col("page") > 0) & (F.col("page") < last)), ["page"], 10.0)
