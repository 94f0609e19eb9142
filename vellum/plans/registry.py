"""Queries over the tables and the SQL that gives the same rows.

Each docstring names the inventory rows (SURVEY section 2) that its query exercises and the stand-in for document data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import values as V
from vellum.operators import assembly, lookups, search, trees
from vellum.plans.base import ORACLE, QUERIES, query  # noqa: F401
from vellum.session import table

_SPACE = r"[\s\x{85}\p{Z}]+"
_PAGE = rf"trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g'))"


def _matches(table_name: str, keys: str, needle: str) -> str:
    n = len(needle)
    return f"""
        WITH p AS (SELECT {keys}, {_PAGE} AS shown FROM {table_name}),
        f AS (SELECT *, string_split(lower(strip_accents(shown)), '{needle}') AS parts FROM p),
        k AS (SELECT *, unnest(range(1, len(parts))) AS match_no FROM f),
        s AS (SELECT *, CAST(list_sum(list_transform(parts[1:match_no], lambda x: length(x))) + (match_no - 1) * {n} AS INT) AS start FROM k),
        w AS (SELECT *, greatest(start - 32, 0) AS l0, least(start + {n} + 32, length(shown)) AS h0 FROM s),
        c AS (SELECT *, l0 + CASE WHEN l0 > 0 THEN length(regexp_extract(substring(shown, l0 + 1, start - l0), '^(.* )', 1)) ELSE 0 END AS l,
            CASE WHEN h0 < length(shown) AND instr(substring(shown, start + {n + 1}, h0 - start - {n}), ' ') > 0 THEN start + {n} + instr(substring(shown, start + {n + 1}, h0 - start - {n}), ' ') - 1 ELSE h0 END AS h FROM w)
        SELECT {keys}, CAST(match_no AS INT) AS match_no, start, substring(shown, start + 1, {n}) AS text,
            concat(CASE WHEN l > 0 THEN '…' ELSE '' END, substring(shown, CAST(l + 1 AS BIGINT), CAST(h - l AS BIGINT)), CASE WHEN h < length(shown) THEN '…' ELSE '' END) AS context FROM c"""


@query(_matches("documents", "doc_id, source", "eaux"))
def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-01, SEA-02, SEA-04, SEA-06: a document is a page of its source; context is 32 characters to each side, cut to blanks."""
    return search.matches(table(spark, sf_dir, "documents"), ["doc_id", "source"], "Eaux")


@query(rf"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(strip_accents({_PAGE})), '[^\p{{L}}\p{{Nd}}\p{{Mn}}\p{{Mc}}]+'), lambda x: x = 'the')) AS BIGINT) AS n_matches
    FROM documents WHERE n_matches > 0""")
def search_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-05: a match with no word character before or behind it."""
    return search.match_counts(table(spark, sf_dir, "documents"), ["doc_id"], "the", whole_word=True)


@query(f"""WITH m AS ({_matches("conversations", "conv_id, turn", "the")}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, match_no) AS INT) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM m),
    c AS (SELECT conv_id, arg_min(rank, (turn < 1)::INT * 1000000 + rank) AS cur FROM r GROUP BY conv_id)
    SELECT conv_id, turn, match_no, start, rank, n, rank = cur AS is_current, rank % n + 1 AS next_rank, (rank + n - 2) % n + 1 AS previous_rank FROM r JOIN c USING (conv_id)""")
def search_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-08, SEA-09: a conversation is a document, its turns are pages; the search starts at page 1 and wraps."""
    found = search.matches(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "the")
    return search.with_steps(found, "conv_id", "turn", 1).drop("text", "context")


@query("""WITH l AS (SELECT source, doc_id, string_split(text, chr(10)) AS x FROM documents),
    e AS (SELECT DISTINCT source, doc_id, unnest(list_distinct([x[1], x[2], x[-1], x[-2]])) AS line FROM l),
    k AS (SELECT DISTINCT source, doc_id, regexp_replace(regexp_replace(line, '[\\s\\p{Z}]+', '', 'g'), '\\p{Nd}', '#', 'g') AS key FROM e WHERE line IS NOT NULL),
    n AS (SELECT *, count(*) OVER (PARTITION BY source, key ORDER BY doc_id RANGE BETWEEN 80 PRECEDING AND 80 FOLLOWING) - 1 AS n FROM k WHERE key <> '')
    SELECT source, doc_id, key FROM n WHERE n >= 2""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-02, STR-08, WIN-02: the first and last two lines of documents of a source; page distance 4 is 80 ids, as 20 sources take turns."""
    lines = F.split("text", "\n")
    edge = F.filter(F.array(F.get(lines, F.lit(0)), F.get(lines, F.lit(1)), F.get(lines, F.size(lines) - 1), F.get(lines, F.size(lines) - 2)), lambda x: x.isNotNull())
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array_distinct(edge)).alias("line"))
    return assembly.running_lines(docs, "source", "doc_id", "line", reach=80)


_RANGES = "(0, 'r', NULL, 1), (3, 'D', NULL, 1), (5, 'R', NULL, 4), (7, 'A', NULL, 26), (9, 'a', 'A-', 52), (11, NULL, 'Cover', 1), (12, 'R', 'P', 1990)"
_ROMAN = "concat(repeat('M', CAST(floor(n / 1000) AS INT)), ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(n // 100) % 10 + 1], ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(n // 10) % 10 + 1], ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1])"
_LETTER = "repeat(chr(CAST(65 + (n - 1) % 26 AS INT)), CAST((n - 1) // 26 + 1 AS INT))"


@query(f"""WITH g(s, style, prefix, f) AS (VALUES {_RANGES}), p AS (SELECT p_size, p_partkey % 40 AS page_index, p_partkey FROM part),
    x AS (SELECT *, f + page_index - s AS n FROM p ASOF JOIN g ON p.page_index >= g.s)
    SELECT p_partkey, page_index, concat(coalesce(prefix, ''), CASE style WHEN 'D' THEN CAST(n AS VARCHAR) WHEN 'R' THEN {_ROMAN} WHEN 'r' THEN lower({_ROMAN}) WHEN 'A' THEN {_LETTER} WHEN 'a' THEN lower({_LETTER}) ELSE '' END) AS label FROM x""")
def page_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04, STR-03, STR-04, JON-01: parts are pages of one document; the label ranges are the ones of FIXTURES B.3 and one more."""
    pages = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("page_index"), F.floor(F.col("p_partkey") / 40).alias("doc"))
    ranges = spark.sql(f"SELECT * FROM VALUES {_RANGES} AS t(start_page, style, prefix, first_number)")
    docs = pages.select("doc").distinct().crossJoin(F.broadcast(ranges))  # seven rows a document
    return assembly.page_labels(pages, "doc", "page_index", docs).select("p_partkey", "page_index", "label")


@query("""SELECT event_id, user_id, o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e
    ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01, JON-02: a user's events look up their last order; of orders at one time the larger key wins."""
    probes = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    keys = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id")
    return lookups.floor_join(probes, keys, "user_id", "ts", "o_orderdate", "o_orderkey", "o_orderkey").select("event_id", "user_id", "o_orderkey")


_GLYPH = "l_suppkey AS page, CAST(l_quantity AS INT) AS code, CAST(round(32 * l_discount) AS INT) AS x, CAST(round(32 * l_tax) AS INT) AS y, l_orderkey * 8 + l_linenumber AS id, l_returnflag"


@query(f"""WITH a AS (SELECT {_GLYPH} FROM lineitem),
    l AS (SELECT *, row_number() OVER (PARTITION BY page, code, x, y ORDER BY id) AS n FROM a WHERE l_returnflag = 'A'),
    r AS (SELECT *, row_number() OVER (PARTITION BY page, code, x, y ORDER BY id) AS n FROM a WHERE l_returnflag = 'R')
    SELECT page, l.code, l.x, l.y, l.id AS left_id, r.id AS right_id FROM l JOIN r USING (page, code, x, y, n)""")
def glyph_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04: a supplier's line items as glyphs of a page, code and place rounded to 1/32; each row is matched once, in order."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*(x.strip() for x in _GLYPH.split(", ")))
    sides = [rows.where(F.col("l_returnflag") == k).select("page", "code", "x", "y", F.col("id").alias(n)) for k, n in (("A", "left_id"), ("R", "right_id"))]
    return lookups.multiset_join(*sides, ["page", "code", "x", "y"], "left_id", "right_id")


_TREE = """SELECT concat('r', r_regionkey) AS id, CAST(NULL AS {s}) AS parent_id, r_name AS name FROM region
    UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM nation
    UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), replace(c_name, '#', '_') FROM customer"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("region", "nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_TREE.format(s="STRING"))


_QUALIFIED = f"""WITH RECURSIVE nodes AS ({_TREE.format(s="VARCHAR")}),
    t AS (SELECT id, 0 AS depth, name AS fqn FROM nodes WHERE parent_id IS NULL UNION ALL SELECT c.id, t.depth + 1, concat(t.fqn, '.', c.name) FROM nodes c JOIN t ON c.parent_id = t.id)"""

#: A region of an even key and a nation of a key that 3 divides are closed; values stand at some levels only.
_KINDS = """SELECT id, parent_id, name, CASE substr(id, 1, 1) WHEN 'r' THEN CAST(substr(id, 2) AS BIGINT) % 2 = 1 WHEN 'n' THEN CAST(substr(id, 2) AS BIGINT) % 3 <> 0 ELSE true END AS is_open,
    CASE WHEN substr(id, 1, 1) = 'r' THEN name WHEN substr(id, 1, 1) = 'n' AND CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN concat(name, '!') END AS kind,
    CASE WHEN substr(id, 1, 1) = 'c' AND CAST(substr(id, 2) AS BIGINT) % 5 = 0 THEN 1 WHEN substr(id, 1, 1) = 'n' THEN 2 END AS flags, CAST(substr(id, 2) AS BIGINT) AS ordinal FROM nodes"""


@query(f"""WITH RECURSIVE nodes AS ({_TREE.format(s="VARCHAR")}), k AS ({_KINDS}),
    t AS (SELECT id, 0 AS depth, name AS fqn, kind, flags, true AS visible, is_open, [ordinal] AS place FROM k WHERE parent_id IS NULL
        UNION ALL SELECT k.id, t.depth + 1, concat(t.fqn, '.', k.name), coalesce(k.kind, t.kind), coalesce(k.flags, t.flags), t.visible AND t.is_open, k.is_open, list_append(t.place, k.ordinal) FROM k JOIN t ON k.parent_id = t.id)
    SELECT id, depth, fqn, kind, flags, visible, array_to_string(place, '/') AS place FROM t""")
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-02, GRA-03, GRA-04, SRC-11: regions, nations and customers as a field tree, an outline and a page tree; qualified names
    and levels, values inherited from the nearest ancestor, entries with open ancestors only, preorder by ordinals."""
    _tree(spark, sf_dir).createOrReplaceTempView("nodes")
    out = trees.climbed(spark.sql(_KINDS), inherited=["kind", "flags"], opened="is_open", ordinal="ordinal")
    return out.withColumn("place", F.array_join(F.transform("place", lambda x: x.cast("string")), "/"))


@query(f"{_QUALIFIED} SELECT id, fqn FROM t WHERE NOT (fqn = 'ASIA' OR starts_with(fqn, 'ASIA.') OR fqn = 'EUROPE.FRANCE' OR starts_with(fqn, 'EUROPE.FRANCE.'))")
def field_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06, JON-07, SET-09's name locks: all fields but the listed ones and their descendants."""
    return trees.selected(_tree(spark, sf_dir), ["ASIA", "EUROPE.FRANCE"], exclude=True)


@query("""SELECT * FROM (VALUES ('Chapter', 'Sect'), ('Body', 'P'), ('Odd', NULL), ('A', 'P'), ('B', 'P'), ('P', 'P'), ('Lost', NULL)) t(type, role)""")
def role_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-01: chains, one that ends in no standard type, a cycle with a standard type and one without."""
    rows = [("Chapter", "Part2"), ("Part2", "Sect"), ("Body", "Text"), ("Text", "P"), ("Odd", "Unknown"), ("A", "B"), ("B", "P"), ("P", "A"), ("Lost", "Found"), ("Found", "Lost")]
    out = trees.roles(spark.createDataFrame(rows, "type string, target string"), ["P", "Sect", "H1"])
    return out.where(F.col("type").isin("Chapter", "Body", "Odd", "A", "B", "P", "Lost"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, SNK-02, INC-04, VIW-14: events as appended revisions of users; the newest wins."""
    return lookups.newest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


_REV = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id {c} GROUP BY user_id"


@query(f"""WITH o AS ({_REV.format(c="% 2 = 0")}), n AS ({_REV.format(c="% 6 <> 0")})
    SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 'added' WHEN n.user_id IS NULL THEN 'deleted' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.user_id = n.user_id WHERE o.event_type IS DISTINCT FROM n.event_type OR o.user_id IS NULL OR n.user_id IS NULL""")
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-08: two states of the users' events compared; each event is in one of them at least."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    older, newer = (lookups.newest(rows.where(c), "user_id", "event_id") for c in ("event_id % 2 = 0", "event_id % 6 <> 0"))
    return lookups.diff(older, newer, "user_id", ["event_type"])


@query("""WITH u AS (SELECT 0 AS part, conv_id, turn FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT 1, conv_id, turn FROM conversations WHERE conv_id % 2 <> 0 OR conv_id % 5 = 0)
    SELECT part, conv_id, turn, row_number() OVER (ORDER BY part, conv_id, turn) - 1 AS new_page FROM u""")
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01, SET-02: two sets of conversations one behind the other, each conversation in one of them at least and
    some in both; turns are pages."""
    c = table(spark, sf_dir, "conversations")
    return assembly.merge([c.where("conv_id % 2 = 0"), c.where("conv_id % 2 <> 0 or conv_id % 5 = 0")], "conv_id", "turn")


@query("""SELECT range_no, conv_id, turn, turn - f AS new_page FROM conversations JOIN (VALUES (0, 0, 2), (1, 1, 4), (2, 3, 100)) r(range_no, f, b) ON turn >= f AND turn < b""")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03, SET-04: page ranges, half-open, that overlap."""
    ranges = spark.sql("SELECT * FROM VALUES (0, 0, 2), (1, 1, 4), (2, 3, 100) AS t(range_no, first, beyond)")
    return assembly.split(table(spark, sf_dir, "conversations"), "conv_id", "turn", ranges)


@query("""SELECT p_partkey, p_type AS name, CASE WHEN k = 0 THEN p_type ELSE concat(p_type, '_', k) END AS new_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS k FROM part)""")
def renamed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: colliding names get numbers; types of parts hold no underscore, so no chain of names collides (`renamed_chains`)."""
    return assembly.renamed(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("name")), "name", "p_partkey")


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type ASC, p_size DESC, p_retailprice ASC, p_partkey) AS place FROM part""")
def portfolio_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-02: files of a portfolio by several keys, each with its direction, and a unique key last."""
    from pyspark.sql import Window

    order = Window.partitionBy("p_brand").orderBy("p_type", F.col("p_size").desc(), "p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(order).alias("place"))


@query("""WITH s AS (SELECT doc_id, quality = 1 AS q, toxic = 1 AS t FROM labels)
    SELECT doc_id, q AND NOT t AS shown, q AND t AS all_on, q OR t AS any_on, NOT q OR NOT t AS any_off, NOT q AND NOT t AS all_off, NOT q AS toggled FROM s""")
def layer_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07, FLT-08: labels as states of two layers; an expression, the four policies and an ordered list of changes."""
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    both = F.array("q", "t")
    each = [assembly.policy(both, k).alias(n) for k, n in (("AllOn", "all_on"), ("AnyOn", "any_on"), ("AnyOff", "any_off"), ("AllOff", "all_off"))]
    changes = F.array(F.lit("Toggle"), F.lit("ON"), F.lit("OFF"))
    toggled = F.when(F.col("q"), assembly.folded_state(F.col("q"), changes)).otherwise(assembly.folded_state(F.col("q"), F.array(F.lit("Toggle"))))
    return rows.select("doc_id", assembly.is_visible(["And", "q", ["Not", "t"]]).alias("shown"), *each, toggled.alias("toggled"))


@query("SELECT doc_id, text AS decoded FROM documents")
def hex_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-01: each whole text as hex digits with blanks among them and an end mark, decoded again."""
    data = F.concat(F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(.{16})", "$1\n "), F.lit(">ff"))
    return table(spark, sf_dir, "documents").select("doc_id", F.decode(T.ascii_hex(data), "UTF-8").alias("decoded"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Absent' WHEN page_id % 3 = 1 THEN 'Matches' ELSE 'DoesNotMatch' END AS status, strlen(html) AS size FROM pages""")
def checksum_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-01, VIW-04: pages as embedded files; the stated digest is missing, right or wrong by page_id."""
    given = F.when(F.col("page_id") % 3 == 1, F.upper(F.md5("html"))).when(F.col("page_id") % 3 == 2, F.md5(F.reverse("html")))
    rows = table(spark, sf_dir, "pages").select("page_id", given.alias("given"), F.md5("html").alias("own"), F.octet_length("html").cast("long").alias("size"))
    return rows.select("page_id", F.when(F.col("given").isNull() | (F.length("given") != 32), "Absent").when(F.lower("given") == F.col("own"), "Matches").otherwise("DoesNotMatch").alias("status"), "size")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN date_trunc('year', o_orderdate) ELSE date_trunc('day', o_orderdate) - INTERVAL 90 MINUTE END AS ts,
    CASE o_orderkey % 4 WHEN 3 THEN 90 END AS offset_min, CASE o_orderkey % 4 WHEN 0 THEN 'Day' WHEN 1 THEN 'Month' WHEN 2 THEN 'Year' ELSE 'Second' END AS "precision" FROM orders""")
def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-01, DAT-02: order dates written with four precisions, one of them with an offset, and read again."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.concat(F.lit("D:"), F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.date_format(d, "yyyyMM")).when(k == 2, F.date_format(d, "yyyy")).otherwise(F.concat(F.date_format(d, "yyyyMMdd"), F.lit("000000+01'30'"))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", V.parsed_date(text).alias("d"))
    return rows.select("o_orderkey", F.col("d.ts").cast("timestamp_ntz").alias("ts"), "d.offset_min", "d.precision")


@query("""SELECT l_orderkey, l_linenumber, round(0.1 + pow(l_discount * 10, 2) * 0.8, 9) AS expo,
    round(CASE WHEN l_discount < 0.05 THEN l_discount / 0.05 ELSE 1 - (l_discount - 0.05) / 0.95 END, 9) AS stitch,
    round(CASE WHEN l_tax > 0.04 THEN l_tax * 2 ELSE 1 - l_tax END + floor(l_quantity / 7 + 0.5), 9) AS calc FROM lineitem""")
def function_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-02, MTH-03, MTH-04: an exponential, a stitched and a calculator function of line items."""
    x = F.col("l_discount")
    line = lambda c0, c1: lambda v: V.exponential(v, c0, c1, 1.0)
    calc = V.calculator("{ 7.0 div round exch dup 0.04 gt { 2.0 mul } { 1.0 exch sub } ifelse add }", F.col("l_tax"), F.col("l_quantity"))[0]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(V.exponential(x * 10, 0.1, 0.9, 2.0), 9).alias("expo"),
        F.round(V.stitched(x, [0.05], [(0.0, 1.0), (0.0, 1.0)], [line(0.0, 1.0), line(1.0, 0.0)]), 9).alias("stitch"), F.round(calc, 9).alias("calc"),
    )


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, v AS median FROM r WHERE k = n // 2 + 1""")
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02: the upper median of prices by return flag."""
    return lookups.upper_median(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")


@query("""SELECT l_suppkey, mode, n FROM (SELECT l_suppkey, CAST(l_quantity AS INT) AS mode, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, CAST(l_quantity AS INT)) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1""")
def body_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: the most frequent quantity of each supplier, of equally frequent ones the smallest."""
    return lookups.mode(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("q")), "l_suppkey", "q")


@query("""SELECT p_brand, p_size, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INT) AS level, count(*) AS n FROM part GROUP BY p_brand, p_size""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: distinct sizes of a brand ranked, the largest first."""
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("level", F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.col("p_size").desc())))


@query("""WITH b AS (SELECT p_partkey, p_size AS l, p_size * 20 AS bo, p_size + p_partkey % 5 AS r, p_size * 20 + 25 AS t FROM part),
    p AS (SELECT l_quantity AS x, l_discount * 10000 AS y, count(*) AS n, sum(l_orderkey) AS s FROM lineitem GROUP BY ALL)
    SELECT p_partkey, CAST(sum(n) AS BIGINT) AS n_points, CAST(sum(s) AS BIGINT) AS keys FROM p JOIN b ON x BETWEEN l AND r AND y BETWEEN bo AND t GROUP BY p_partkey""")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPA-01, SPA-02: boxes of all parts, points of all line items, through a grid; the points of each box. Line items at one
    place are one point before they meet the boxes."""
    boxes = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS left", "p_size * 20 AS bottom", "p_size + p_partkey % 5 AS right", "p_size * 20 + 25 AS top")
    points = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_quantity AS x", "l_discount * 10000 AS y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("s"))
    return lookups.points_in_boxes(points, boxes, 10.0).groupBy("p_partkey").agg(F.sum("n").alias("n_points"), F.sum("s").alias("keys"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(len(list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: x <> '')) AS INT) AS n_words,
    CAST(length(trim(regexp_replace(line, '{_SPACE}', ' ', 'g'))) AS INT) AS n_chars FROM l""")
def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-06, M8: the lines of each text and their words; gaps are white space here."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.filter(F.split("line", _SPACE), lambda w: w != "")
    return lines.select("doc_id", "line_no", F.size(words).alias("n_words"), F.length(F.array_join(words, " ")).alias("n_chars"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey // 3 AS src, o_orderkey AS dst FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 1 FROM orders), t AS (SELECT 1::BIGINT AS id UNION SELECT dst FROM e JOIN t ON e.src = t.id) SELECT id FROM t""")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: orders as objects that refer to one another, walked from the first; cycles end."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    down = orders.where(key % 7 != 0).select(F.floor(key / 3).alias("src"), key.alias("dst"))
    edges = down.unionByName(orders.select(key.alias("src"), F.lit(1).cast("long").alias("dst")))
    return trees.reachable(edges, spark.createDataFrame([(1,)], "id long"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY event_type")
def diagnostics_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04: events as diagnostics, reported once a code with how often and where they came."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""SELECT user_id, event_id, CAST(least(3, coalesce(min(lvl) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3)) AS INT) AS allowed FROM (SELECT user_id, event_id, 1 + event_id % 3 AS lvl FROM events)""")
def permitted_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-09: the level that a user's earlier events leave, from 3 downwards."""
    from pyspark.sql import Window

    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (1 + F.col("event_id") % 3).alias("lvl"))
    return rows.select("user_id", "event_id", F.least(F.lit(3), F.coalesce(F.min("lvl").over(before), F.lit(3))).cast("int").alias("allowed"))


@query(f"""{_QUALIFIED}, kept AS (SELECT DISTINCT concat('c', o_custkey) AS id FROM orders WHERE o_totalprice > 400000), f AS (SELECT t.fqn FROM t JOIN kept USING (id))
    SELECT id, depth FROM t WHERE EXISTS (SELECT 1 FROM f WHERE f.fqn = t.fqn OR starts_with(f.fqn, t.fqn || '.'))""")
def pruned_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06: the tree's items that are kept or have a kept descendant; kept are customers with a large order."""
    kept = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("id")).distinct()
    return trees.pruned(trees.qualified(_tree(spark, sf_dir)), kept).select("id", "depth")


@query("SELECT conv_id, turn, CAST(k AS INT) AS kept_no FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 3")
def limited_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04: at most three turns of a conversation, as limits on operands keep the first ones."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("kept_no"))
    return rows.where("kept_no <= 3")


from vellum.plans import files, layouts, scalars, tables  # noqa: E402, F401
