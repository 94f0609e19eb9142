"""Queries of lookups, spatial joins, sets and views, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import assembly, lookups, trees
from vellum.plans.base import query
from vellum.session import table


@query("""SELECT s_name, arg_min(s_suppkey, s_suppkey) AS value FROM (SELECT concat('k', s_suppkey % 37) AS s_name, s_suppkey FROM supplier) GROUP BY s_name""")
def exact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-03: entries of a name tree with keys that repeat; the first in tree order counts."""
    entries = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), (F.col("s_suppkey") % 37).cast("string")).alias("s_name"), F.col("s_suppkey").alias("value"))
    return lookups.first_by_key(entries, "s_name", "value")


@query("""WITH n AS (SELECT concat('d', c_custkey) AS name, o.o_orderkey AS target FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
    p AS (SELECT l_orderkey AS object, min(l_suppkey) AS page FROM lineitem GROUP BY 1)
    SELECT name, target, page FROM n LEFT JOIN p ON target = object""")
def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-05: names (customers) lead to explicit destinations (their first orders), those to pages; a broken link stays, without a page."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("target"))
    names = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("name"), "target")
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("page"))
    return names.join(pages, F.col("target") == F.col("l_orderkey"), "left").select("name", "target", "page")


@query("""WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS element, l_suppkey AS page, l_partkey % 50 AS mcid FROM lineitem), m AS (SELECT page, mcid, min(element) AS element FROM e GROUP BY 1, 2)
    SELECT s_suppkey AS page, k AS mcid, element FROM supplier CROSS JOIN range(0, 60, 7) r(k) LEFT JOIN m ON page = s_suppkey AND mcid = k""")
def structure_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-08: the structure element (a line item) of a page (its supplier) and a marked-content id; the first one counts."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("element"), F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 50).alias("mcid"))
    known = e.groupBy("page", "mcid").agg(F.min("element").alias("element"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.explode(F.expr("sequence(0L, 56L, 7L)")).alias("mcid"))
    return asked.join(known, ["page", "mcid"], "left")


@query("""WITH l AS (SELECT p_partkey AS page, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE p_brand END AS label FROM part), a AS (SELECT DISTINCT p_brand AS asked FROM part UNION SELECT DISTINCT upper(p_brand) FROM part UNION SELECT 'none')
    SELECT asked, coalesce((SELECT min(page) FROM l WHERE label = asked), (SELECT min(page) FROM l WHERE lower(label) = lower(asked))) AS page FROM a""")
def pages_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09: brands as page labels, some in lower case; the first page with the label itself, else in any case."""
    part = table(spark, sf_dir, "part")
    labels = part.select(F.col("p_partkey").alias("page"), F.when(F.col("p_partkey") % 3 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("label"))
    asked = part.select(F.col("p_brand").alias("asked")).union(part.select(F.upper("p_brand"))).union(spark.sql("SELECT 'none'")).distinct()
    return lookups.page_by_label(labels, asked, "label", "page")


@query("""SELECT item, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event, CAST(sum(has_parent) AS BIGINT) AS with_parent FROM (SELECT user_id AS item, event_id, CASE WHEN event_id % 10 <> 0 AND event_id // 10 IN (SELECT event_id FROM events) THEN 1 ELSE 0 END AS has_parent FROM events) GROUP BY item""")
def annotation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-10: annotations (events) by page (user), and those whose parent annotation exists."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("item"))
    parents = e.select(F.col("event_id").alias("parent"), F.lit(1).alias("hit"))
    met = e.withColumn("parent", F.when(F.col("event_id") % 10 != 0, F.floor(F.col("event_id") / 10))).join(parents, "parent", "left")
    return met.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.sum(F.coalesce("hit", F.lit(0))).alias("with_parent"))


@query("""WITH RECURSIVE f AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN n_nationkey // 3 END AS parent, n_name AS name FROM nation),
    t AS (SELECT id, 0 AS depth, name AS path FROM f WHERE parent IS NULL UNION ALL SELECT f.id, t.depth + 1, concat(t.path, '.', f.name) FROM f JOIN t ON f.parent = t.id),
    s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE concat('<', s_nationkey, '>', s_name) END AS name, s_nationkey FROM supplier)
    SELECT s_suppkey, s.name, CASE WHEN s_suppkey % 4 <> 0 THEN t.path END AS folder, CASE WHEN s_suppkey % 4 <> 0 THEN t.depth END AS depth FROM s LEFT JOIN t ON t.id = s_nationkey""")
def portfolio_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-11, GRA-05: files (suppliers) whose names begin with their folder's id, and the tree of folders (nations)."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 3)).alias("parent_id"), F.col("n_name").alias("name"))
    folders = trees.qualified(nation).select(F.col("id").alias("folder_id"), F.col("fqn").alias("folder"), "depth")
    name = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise(F.concat(F.lit("<"), F.col("s_nationkey").cast("string"), F.lit(">"), F.col("s_name")))
    files = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return files.withColumn("folder_id", lookups.folder_of(F.col("name"))).join(F.broadcast(folders), "folder_id", "left").select("s_suppkey", "name", "folder", "depth")  # folders of one portfolio


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 1 THEN n_name END, CASE WHEN n_nationkey % 2 = 0 THEN r_name END, 'none') AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def attribute_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-07: an attribute of an element (customer), of its class (nation), of an ancestor (region), or its default."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at any scale
    k = F.col("c_custkey") % 3
    value = lookups.owned_attribute(F.when(k == 0, F.col("c_mktsegment")), F.array(F.lit(None).cast("string"), F.when(k == 1, F.col("n_name"))), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")), F.lit("none"))
    return c.select("c_custkey", value.alias("value"))


@query("""SELECT o_custkey, greatest('1.4', max(v)) AS version, CASE WHEN max(v) > '1.4' THEN arg_min(f, (f, 1)) FILTER (v = m) END AS feature FROM
    (SELECT *, max(v) OVER (PARTITION BY o_custkey) AS m FROM (SELECT o_custkey, o_orderpriority AS f, CASE o_orderpriority WHEN '1-URGENT' THEN '2.0' WHEN '2-HIGH' THEN '1.7' WHEN '3-MEDIUM' THEN '1.3' WHEN '4-LOW' THEN '1.7' END AS v FROM orders)) GROUP BY o_custkey""")
def version_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06: the version that a customer's orders, as features, need; 1.4 at least."""
    needs = {"1-URGENT": "2.0", "2-HIGH": "1.7", "3-MEDIUM": "1.3", "4-LOW": "1.7"}
    return lookups.required_version(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", needs, "1.4")


@query("""SELECT event_id, f & 2 = 0 AND NOT (f & 1 <> 0 AND event_type = 'view') AND f & 4 <> 0 AS printed, f & 2 = 0 AND NOT (f & 1 <> 0 AND event_type = 'view') AND f & 32 = 0 AS viewed FROM (SELECT *, event_id % 64 AS f FROM events)""")
def annotation_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10: events as annotations with flags, one type of them unknown, in print and on screen."""
    flags, known = F.col("event_id") % 64, F.col("event_type") != "view"
    return table(spark, sf_dir, "events").select("event_id", assembly.annotation_shown(flags, known, True).alias("printed"), assembly.annotation_shown(flags, known, False).alias("viewed"))


@query("""SELECT p_partkey, p_size AS l FROM part WHERE p_size < 30 AND p_size + 10 > 12 AND p_retailprice < 1500 AND p_retailprice + 50 > 1000""")
def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: boxes of parts that reach into a crop box; touching its edge isn't enough."""
    from vellum.operators import layout

    boxes = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS l", "p_size AS left", "p_size + 10 AS right", "p_retailprice AS bottom", "p_retailprice + 50 AS top")
    return layout.inside_crop(boxes, F.lit(12), F.lit(1000), F.lit(30), F.lit(1500)).select("p_partkey", "l")


@query("""WITH s AS (SELECT doc_id AS id, quality = 1 AS state FROM labels), b AS (SELECT id, CASE WHEN id % 11 = 0 THEN false WHEN id % 7 = 0 THEN true ELSE state END AS shown FROM s),
    r AS (SELECT id, id % 50 AS collection FROM s), t AS (SELECT id FROM s WHERE id % 100 = 3), h AS (SELECT DISTINCT collection FROM r JOIN t USING (id))
    SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN true WHEN id % 50 IN (SELECT collection FROM h) THEN false ELSE shown END AS shown FROM b""")
def layer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08: states of layers (labels) by a configuration, and after some were turned on, with their radio buttons."""
    s = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("state"))
    # The configuration's lists stand in the rows here, as an expression of the id.
    base = s.select("id", F.when(F.col("id") % 11 == 0, False).when(F.col("id") % 7 == 0, True).otherwise(F.col("state")).alias("shown"))
    return assembly.switched_on(base, s.select("id", (F.col("id") % 50).alias("collection")), s.where("id % 100 = 3").select("id"))


@query("""SELECT id, CASE WHEN id IN ('b', 'd') THEN false WHEN id IN ('a', 'b') THEN true ELSE state END AS unchanged, CASE WHEN id IN ('b', 'd') THEN false WHEN id IN ('a', 'b') THEN true ELSE false END AS off
    FROM (VALUES ('a', false), ('b', true), ('c', true), ('d', true), ('e', false)) t(id, state)""")
def layer_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08: a configuration's base state, its ON list and its OFF list, which has the last word."""
    groups = spark.createDataFrame([("a", False), ("b", True), ("c", True), ("d", True), ("e", False)], "id string, state boolean")
    own = assembly.default_states(groups, "Unchanged", ["a", "b"], ["b", "d"]).withColumnRenamed("shown", "unchanged")
    return own.join(assembly.default_states(groups, "OFF", ["a", "b"], ["b", "d"]).withColumnRenamed("shown", "off"), "id")


@query("""SELECT p_partkey, c_custkey FROM (SELECT p_partkey, p_size AS l, p_size + 3 AS r, p_retailprice AS b, p_retailprice + 4 AS t FROM part) p
    JOIN (SELECT c_custkey, c_nationkey * 2 AS l2, c_nationkey * 2 + 2 AS r2, c_acctbal / 10 + 900 AS b2, c_acctbal / 10 + 903 AS t2 FROM customer) c ON l <= r2 AND l2 <= r AND b <= t2 AND b2 <= t""")
def boxes_in_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPA-03, SPA-04: boxes of parts (links) that overlap rectangles of customers, through a grid."""
    boxes = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS left", "p_size + 3 AS right", "p_retailprice AS bottom", "p_retailprice + 4 AS top")
    rectangles = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey * 2 AS r_left", "c_nationkey * 2 + 2 AS r_right", "c_acctbal / 10 + 900 AS r_bottom", "c_acctbal / 10 + 903 AS r_top")
    return lookups.boxes_in_rectangles(boxes, rectangles, 8.0).select("p_partkey", "c_custkey")


@query("""WITH i AS (SELECT s_nationkey AS page, s_suppkey AS item, s_suppkey % 13 * 10.0 AS l, s_suppkey % 13 * 10.0 + 4 AS r, s_suppkey % 7 * 10.0 AS b, s_suppkey % 7 * 10.0 + 4 AS t FROM supplier),
    m AS (SELECT c_custkey, item, sqrt(pow(greatest(l - x, x - r, 0), 2) + pow(greatest(b - y, y - t, 0), 2)) AS d FROM (SELECT c_custkey, c_nationkey, c_custkey % 131 AS x, c_custkey % 71 AS y FROM customer) JOIN i ON page = c_nationkey)
    SELECT c_custkey, min(struct_pack(d := d, i := item)).i AS item, round(min(d), 6) AS distance FROM m GROUP BY c_custkey""")
def nearest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPA-05: points of customers, glyph boxes of suppliers on the page of their nation; the nearest box."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS page", "s_suppkey AS item", "s_suppkey % 13 * 10.0D AS left", "s_suppkey % 13 * 10.0D + 4 AS right", "s_suppkey % 7 * 10.0D AS bottom", "s_suppkey % 7 * 10.0D + 4 AS top")
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS page", "c_custkey", "CAST(c_custkey % 131 AS DOUBLE) AS x", "CAST(c_custkey % 71 AS DOUBLE) AS y")
    return lookups.nearest(c, s, "page", "c_custkey", "item").withColumn("distance", F.round("distance", 6))


@query("""SELECT p_partkey, least(x0, x1, x2, x3) AS "left", least(y0, y1, y2, y3) AS bottom, greatest(x0, x1, x2, x3) AS "right", greatest(y0, y1, y2, y3) AS top FROM
    (SELECT p_partkey, 2 * l + b + 5 AS x0, l * -1 + 3 * b - 7 AS y0, 2 * r + b + 5 AS x1, r * -1 + 3 * b - 7 AS y1, 2 * l + t + 5 AS x2, l * -1 + 3 * t - 7 AS y2, 2 * r + t + 5 AS x3, r * -1 + 3 * t - 7 AS y3 FROM (SELECT p_partkey, p_size AS l, p_size + p_partkey % 9 AS r, p_partkey % 17 AS b, p_partkey % 17 + 3 AS t FROM part))""")
def transformed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPA-07: boxes of parts through a matrix."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS l", "p_size + p_partkey % 9 AS r", "p_partkey % 17 AS b", "p_partkey % 17 + 3 AS t")
    return rows.select("p_partkey", lookups.transformed_box(F.col("l"), F.col("b"), F.col("r"), F.col("t"), [2, -1, 1, 3, 5, -7]).alias("box")).select("p_partkey", "box.*")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY encode(name)) AS by_bytes FROM (SELECT c_custkey, concat(['ä', 'Z', 'a', '日', '😀', 'é'][c_custkey % 6 + 1], c_custkey) AS name, c_custkey FROM customer)""")
def byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03: names of customers in the order of their bytes. Places come from counts of ranges, so no task orders all names."""
    names = F.array(*[F.lit(x) for x in ("ä", "Z", "a", "日", "😀", "é")])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.encode(F.concat(F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int")), F.col("c_custkey").cast("string")), "UTF-8").alias("k"))
    return lookups.placed(rows, ["k"], "by_bytes").select("c_custkey", "by_bytes")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_quantity, l_orderkey, l_linenumber) AS by_top, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice DESC, l_orderkey, l_linenumber) AS by_left FROM lineitem""")
def total_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01: line items of a page (supplier) from the top, and from the left; ties end at a unique key."""
    ends = ["l_orderkey", "l_linenumber"]
    top = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_quantity", *ends)
    left = Window.partitionBy("l_suppkey").orderBy("l_quantity", F.col("l_extendedprice").desc(), *ends)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", *ends, F.row_number().over(top).alias("by_top"), F.row_number().over(left).alias("by_left"))


@query("""WITH i AS (SELECT conv_id, CASE WHEN turn >= 1 THEN turn + 2 ELSE turn END AS page, role FROM conversations UNION ALL SELECT conv_id, 1 + n, 'new' FROM (SELECT DISTINCT conv_id FROM conversations) CROSS JOIN range(2) r(n)),
    d AS (SELECT conv_id, CASE WHEN page >= 3 THEN page - 1 ELSE page END AS page, role FROM i WHERE page <> 2)
    SELECT conv_id, page, CASE WHEN page = 0 THEN 1 WHEN page = 1 THEN 0 ELSE page END AS moved, role FROM d""")
def page_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-07: turns as pages of each conversation: two put in, one taken out, one moved."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "role")
    new = c.select("conv_id").distinct().select("conv_id", F.explode(F.expr("array(0L, 1L)")).alias("page"), F.lit("new").alias("role"))
    rows = c.withColumn("page", F.when(F.col("page") >= 1, F.col("page") + 2).otherwise(F.col("page"))).unionByName(new.withColumn("page", F.col("page") + 1))
    rows = assembly.removed(rows, "page", 2, 3)
    return rows.withColumn("moved", assembly.moved(F.col("page"), 0, 1))


_EDGES = "SELECT o_orderkey // 3 AS src, o_orderkey AS dst FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 1 FROM orders"


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    down = orders.where(key % 7 != 0).select(F.floor(key / 3).alias("src"), key.alias("dst"))
    edges = down.unionByName(orders.select(key.alias("src"), F.lit(1).cast("long").alias("dst")))
    return orders.select(key.alias("id")), edges, spark.createDataFrame([(1,)], "id long")


@query(f"""WITH RECURSIVE e AS ({_EDGES}), t AS (SELECT 1::BIGINT AS id UNION SELECT dst FROM e JOIN t ON e.src = t.id) SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM t)""")
def garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-10: orders as objects that nothing leads to from the first."""
    return trees.garbage(*_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), t AS (SELECT 1::BIGINT AS id UNION SELECT dst FROM e JOIN t ON e.src = t.id), n AS (SELECT id, row_number() OVER (ORDER BY id) + 99 AS new_id FROM t)
    SELECT a.new_id AS src, b.new_id AS dst FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst""")
def copied_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-06: a deep copy of what the first order leads to, each object once, with its references under the new numbers."""
    _, edges, roots = _edges(spark, sf_dir)
    return trees.copied(edges, roots, 100)[1]


@query("""SELECT * FROM (VALUES (1, 'a', 'a'), (2, 'a', 'a_1'), (3, 'a_1', 'a_1_1'), (4, 'b', 'b'), (5, 'b_1', 'b_1'), (6, 'b', 'b_2'), (7, 'a', 'a_2'), (8, 'c', 'c'), (9, 'c', 'c_1'), (10, 'a_1', 'a_1_2')) t(id, name, new_name)""")
def renamed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: names that are another's numbered form; each takes the first that is free."""
    names = ["a", "a", "a_1", "b", "b_1", "b", "a", "c", "c", "a_1"]
    return assembly.renamed(spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "id int, name string"), "name", "id")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN n_name END) AS title, CASE WHEN c_custkey % 2 = 0 THEN 'metadata' WHEN c_custkey % 3 = 0 THEN 'information' END AS origin, c_custkey % 6 = 0 AND c_name <> n_name AS differs FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def combined_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VIW-03: a title from the metadata, else from the information dictionary, and whether they differ."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
    xmp, info = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, F.col("n_name"))
    return c.select("c_custkey", F.coalesce(xmp, info).alias("title"), F.when(xmp.isNotNull(), "metadata").when(info.isNotNull(), "information").alias("origin"), F.coalesce(xmp != info, F.lit(False)).alias("differs"))


@query(r"""SELECT doc_id, 'language' AS rule FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id, 'title' FROM documents WHERE text = '' OR text IS NULL OR length(string_split(text, chr(10))[1]) > 200
    UNION ALL SELECT doc_id, 'length' FROM documents WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'controls' FROM documents WHERE regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VIW-16: rules over documents, a row to each that one breaks; one scan for all rules."""
    text, first = F.col("text"), F.get(F.split("text", "\n"), F.lit(0))
    language = F.when(F.col("doc_id") % 9 == 0, "!").otherwise(F.col("lang"))
    rules = {
        "language": ~language.rlike("^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"), "title": text.isNull() | (text == "") | (F.length(first) > 200),
        "length": F.col("n_chars") != F.length(text), "controls": text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(broken).alias("rule"))


@query("""WITH r AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 1 ELSE 2 END AS lvl FROM conversations)
    SELECT conv_id, turn, (SELECT min(b.turn) FROM r b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.lvl = 1) AS next_heading, (SELECT max(b.turn) FROM r b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.lvl = 1) AS previous_heading FROM r a""")
def tree_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-15: from each turn, as an element in preorder, the next and the previous one of a role."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    hit = F.when(F.col("role") == "user", F.col("turn"))
    after, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.min(hit).over(after).alias("next_heading"), F.max(hit).over(before).alias("previous_heading"))


@query("""WITH x AS (SELECT l_orderkey AS obj, l_linenumber AS revision, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'R' THEN 'stream' ELSE 'free' END AS kind, l_partkey AS place FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY revision DESC, CASE kind WHEN 'table' THEN 0 WHEN 'stream' THEN 1 ELSE 2 END, place) AS k FROM (SELECT obj, (revision + 1) // 2 AS revision, kind, place FROM x))
    SELECT obj, revision, kind, place FROM r WHERE k = 1""")
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01: entries of cross-reference sections; the newest section wins, and within one the table's entry beats the hybrid
    stream's, and a free entry gives way to both."""
    kind = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "R", "stream").otherwise("free")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obj"), F.floor((F.col("l_linenumber") + 1) / 2).alias("revision"), kind.alias("kind"), F.col("l_partkey").alias("place"))
    rank = F.when(F.col("kind") == "table", 0).when(F.col("kind") == "stream", 1).otherwise(2)
    best = F.min_by(F.struct("revision", "kind", "place"), F.struct(-F.col("revision"), rank, "place"))
    return rows.groupBy("obj").agg(best.alias("e")).select("obj", "e.*")


@query("""SELECT s_nationkey, coalesce(CASE WHEN m > 0 THEN m END, 12.5) AS median FROM (SELECT s_nationkey, list_sort(list(CASE WHEN s_nationkey % 4 = 0 THEN NULL WHEN s_nationkey % 4 = 1 THEN -abs(s_acctbal) ELSE abs(s_acctbal) END) FILTER (s_nationkey % 4 <> 0)) AS l, l[len(l) // 2 + 1] AS m FROM supplier GROUP BY s_nationkey)""")
def medians_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02: upper medians, with a fallback where a key has no values or the median isn't above 0."""
    k = F.col("s_nationkey") % 4
    value = F.when(k == 1, -F.abs("s_acctbal")).when(k > 1, F.abs("s_acctbal"))
    return lookups.upper_median(table(spark, sf_dir, "supplier").select("s_nationkey", value.alias("v")), "s_nationkey", "v", fallback=12.5)


@query("""WITH m AS (SELECT conv_id, turn, unnest(range(1, len(string_split(lower(text), 'the')))) AS match_no FROM conversations), r AS (SELECT conv_id, turn, CAST(match_no AS INT) AS match_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn, match_no) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM m)
    SELECT conv_id, turn, match_no, rank = (5 - 1) % n + 1 AS is_current FROM r""")
def search_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-09: the current match moved to the fifth of each conversation, wrapping."""
    from vellum.operators import search

    found = search.with_steps(search.matches(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "the", match_marks=True), "conv_id", "turn")
    return search.moved_to(found, "conv_id", F.lit(5)).select("conv_id", "turn", "match_no", "is_current")


@query("""WITH e AS (SELECT conv_id, conv_id % 3 AS first, conv_id % 3 + 2 AS beyond FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT conv_id, turn, turn - first AS new_page FROM conversations JOIN e USING (conv_id) WHERE turn >= first AND turn < beyond""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02, SET-03: of each conversation a range of its turns, appended and renumbered."""
    c = table(spark, sf_dir, "conversations")
    return c.where((F.col("turn") >= F.col("conv_id") % 3) & (F.col("turn") < F.col("conv_id") % 3 + 2)).select("conv_id", "turn", (F.col("turn") - F.col("conv_id") % 3).alias("new_page"))
