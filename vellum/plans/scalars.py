"""Queries of scalar functions and filters, and the SQL that gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import filters as X
from vellum.functions import text as T
from vellum.functions import values as V
from vellum.operators import search
from vellum.plans.base import query
from vellum.session import table

#: Chains by doc_id: names, and parameters of the last stage.
CHAINS = [
    ("AHx", {}), ("A85", {}), ("LZW", {}), ("Fl", {}), ("RL", {}), ("A85 Fl", {"Predictor": 12, "Columns": 16}), ("AHx LZW", {"Predictor": 15, "Columns": 8, "Colors": 3}),
    ("A85 RL Fl", {"Predictor": 2, "Columns": 4, "Colors": 3}), ("Fl", {"Predictor": 10, "Columns": 7}), ("LZW", {"Predictor": 11, "Columns": 5}), ("Fl", {"Predictor": 13, "Columns": 9}), ("Fl", {"Predictor": 14, "Columns": 6}),
]


@query(f"""SELECT doc_id, strlen(text) AS n_bytes, md5(text) AS digest, CAST(NULL AS VARCHAR) AS failed, ['{"','".join(n for n, _ in CHAINS)}'][doc_id % {len(CHAINS)} + 1] AS chain FROM documents""")
def filter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-01 to FIL-06, FIL-12, EXT-02: each whole text through one of twelve chains of encoders and predictors and back."""
    made = [F.array(*[F.struct(F.lit(n).alias("name"), (F.create_map(*[F.lit(x) for kv in p.items() for x in kv]) if p and k == names.count(" ") else F.lit(None).cast("map<string,int>")).alias("parms")) for k, n in enumerate(names.split())]) for names, p in CHAINS]
    which = (F.col("doc_id") % len(CHAINS)).cast("int")
    chain = F.coalesce(*[F.when(which == k, c) for k, c in enumerate(made)])
    size = F.octet_length("text")
    width = F.coalesce(*[F.when(which == k, p.get("Columns", 1) * p.get("Colors", 1)) for k, (_, p) in enumerate(CHAINS)])
    raw = F.encode(F.concat("text", F.repeat(F.lit(" "), F.pmod(-size, width).cast("int"))), "UTF-8")  # whole rows for the predictors
    rows = table(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("n_bytes"), chain.alias("chain"), raw.alias("raw"))
    rows = rows.select("doc_id", "n_bytes", "chain", X.decoded(X.encoded(F.col("raw"), F.col("chain")), F.col("chain")).alias("d"))
    return rows.select("doc_id", "n_bytes", F.md5(F.substring(F.col("d.data"), F.lit(1), F.col("n_bytes").cast("int"))).alias("digest"), F.col("d.failed").alias("failed"), F.array_join(F.transform("chain", lambda x: x["name"]), " ").alias("chain"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'narrow or wide' WHEN 1 THEN 'wide' ELSE 'utf-8' END AS kind, text AS decoded FROM documents")
def text_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-02: texts written as text strings in each encoding, two of them with a language escape, and read again."""
    text, k = F.col("text"), F.col("doc_id") % 3
    escape = "\u001benUS\u001b"
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode(F.concat(F.lit(escape), text), "UTF-16BE"))
    utf8 = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.concat(F.lit(escape[:3] + "\u001b"), text), "UTF-8"))
    raw = F.when(k == 0, T.encoded_text_string(text)).when(k == 1, wide).otherwise(utf8)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "narrow or wide").when(k == 1, "wide").otherwise("utf-8").alias("kind"), T.text_string(raw).alias("decoded"))


@query("""SELECT p_partkey, p_partkey % 3999 + 1 AS n, CAST(p_partkey % 3999 + 1 AS INT) AS parsed, 0 AS odd FROM part""")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03, STR-05: part keys as numerals, lower case or upper, read again; a numeral in an unusual spelling isn't one."""
    n = F.col("p_partkey") % 3999 + 1
    roman = F.when(F.col("p_partkey") % 2 == 0, F.lower(T.roman(n))).otherwise(T.roman(n))
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), T.roman_value(roman).alias("parsed"), T.roman_value(F.concat(roman, F.lit("iI"))).alias("odd"))


_MARKERS = "'•', '(b)', 'iv.', '12)', '◦word', 'IX)', '(c', '1234.', '–', 'x.', '■', 'word'"


@query(f"""WITH m AS (SELECT p_partkey, [{_MARKERS}][p_partkey % 12 + 1] AS word, p_partkey % 12 AS k FROM part)
    SELECT p_partkey, word, CASE WHEN k IN (0, 4, 8, 10) THEN 'Bullet' WHEN k IN (1, 9) THEN 'Letter' WHEN k IN (2, 5) THEN 'Roman' WHEN k = 3 THEN 'Number' END AS kind,
    [0, 2, 0, 1, 0, 1, NULL, NULL, 0, 0, 0, NULL][k + 1] AS style, [0, 2, 0, 12, 0, 0, NULL, NULL, 0, 24, 0, NULL][k + 1] AS value, [0, 0, 4, 0, 0, 9, NULL, NULL, 0, 10, 0, NULL][k + 1] AS roman,
    CASE k WHEN 0 THEN 'Disc' WHEN 4 THEN 'Circle' WHEN 8 THEN 'Unordered' WHEN 10 THEN 'Square' END AS numbering FROM m""")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06: first words of lines, by part key, as list markers."""
    words = F.array(*[F.lit(x.strip().strip("'")) for x in _MARKERS.split(", ")])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(words, (F.col("p_partkey") % 12 + 1).cast("int")).alias("word"))
    return rows.withColumn("m", T.list_marker(F.col("word"))).select("p_partkey", "word", "m.*")


_LABELS = "'Figure 3. ', 'TABLE IV', 'Chart 1 Sales of ', 'Fig. 2: ', 'figure 3. ', 'Figure of ', 'Table A-1 – ', 'Map 7 of '"


@query(f"""SELECT o_orderkey, concat([{_LABELS}][o_orderkey % 8 + 1], o_orderpriority) AS line, (o_orderkey % 8 IN (0, 1, 2, 3, 6)) AS is_caption,
    concat(['en', 'pt-BR', 'zh-Hant-TW', 'e', 'en_US'][o_orderkey % 5 + 1]) AS tag, o_orderkey % 5 < 3 AS is_tag FROM orders""")
def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, STR-09: lines with and without a caption's label, by order key, and tags with and without a language tag's shape."""
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % n + 1).cast("int"))
    line = F.concat(at([x.strip("'") for x in _LABELS.split(", ")], 8), F.col("o_orderpriority"))
    tag = at(["en", "pt-BR", "zh-Hant-TW", "e", "en_US"], 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"), T.is_caption(line).alias("is_caption"), tag.alias("tag"), T.is_language_tag(tag).alias("is_tag"))


@query("""SELECT * FROM (VALUES ('plain', 'Café', 0, 0), ('plain', 'cafe', 0, 9), ('plain', 'CAFE', 1, 0), ('case', 'cafe', 0, 9), ('marks', 'Café', 0, 0), ('marks, decomposed', 'Café', 0, 0), ('wide, case', 'cafe', 0, 9),
    ('ligature', 'eﬃ', 2, 1), ('decomposed text', 'Cafe' || chr(769), 3, 0), ('long s', 'ſo', 2, 6), ('double acute', 'hős', 4, 0), ('words', 'cat', 5, 0), ('words', 'cat', 5, 16)) t(kind, text, page, start)""")
def search_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-03, SEA-05: small pages with decomposed, full-width and joined characters, and the matches of several queries."""
    rows = [(0, "Caf\u00e9 one cafe two"), (1, "CAFE three"), (2, "oe\ufb03ce \u017fome"), (3, "Cafe\u0301 noir"), (4, "h\u0151s"), (5, "cat concatenate cat, scatter")]
    pages = spark.createDataFrame(rows, "page int, text string")
    marks, both = {"match_marks": True}, {"match_case": True, "match_marks": True}
    asked = [
        ("plain", "cafe", {}, (0, 1)), ("case", "cafe", both, (0, 1)), ("marks", "caf\u00e9", marks, (0, 1)), ("marks, decomposed", "cafe\u0301", marks, (0, 1)), ("wide, case", "\uff43\uff41\uff46\uff45", both, (0, 1)),
        ("ligature", "effi", {}, (2,)), ("decomposed text", "CAF\u00c9", marks, (3,)), ("long s", "so", {}, (2,)), ("double acute", "hos", {}, (4,)), ("words", "cat", {"whole_word": True}, (5,)),
    ]
    out = None
    for kind, needle, options, on in asked:
        own = search.matches(pages.where(F.col("page").isin(*on)), ["page"], needle, **options).select(F.lit(kind).alias("kind"), "text", "page", "start")
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN date_trunc('year', o_orderdate) WHEN 3 THEN date_trunc('day', o_orderdate) + INTERVAL 90 MINUTE
        WHEN 4 THEN date_trunc('day', o_orderdate) + INTERVAL 5405250 MILLISECOND END AS ts, CASE o_orderkey % 6 WHEN 3 THEN -90 WHEN 4 THEN 0 END AS offset_min,
    CASE o_orderkey % 6 WHEN 0 THEN 'Day' WHEN 1 THEN 'Month' WHEN 2 THEN 'Year' WHEN 3 THEN 'Minute' WHEN 4 THEN 'FractionOfSecond' END AS "precision" FROM orders""")
def metadata_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-03: order dates written as metadata dates of five precisions, one with an offset, and a sixth that is no date."""
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    day = F.date_format(d, "yyyy-MM-dd")
    text = F.when(k == 0, F.concat(F.lit(" "), day)).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy"))
    text = text.when(k == 3, F.concat(day, F.lit("T00:00-01:30"))).when(k == 4, F.concat(day, F.lit("T01:30:05.25Z"))).otherwise(F.concat(F.lit("D:"), F.date_format(d, "yyyyMMdd")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", V.xmp_date(text).alias("d"))
    return rows.select("o_orderkey", F.col("d.ts").cast("timestamp_ntz").alias("ts"), "d.offset_min", "d.precision")


@query("""SELECT o_orderkey, k, CASE k WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true END AS repaired, CASE k WHEN 0 THEN 60 WHEN 1 THEN 60 END AS offset_min FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)""")
def repaired_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-01: dates that need a repair (no mark in the offset, no D:, a day and a month out of range, a blank behind) or can't be read."""
    k, day = F.col("o_orderkey") % 6, F.date_format("o_orderdate", "yyyyMMdd")
    text = F.when(k == 0, F.concat(F.lit("D:"), day, F.lit("0000+01'00'"))).when(k == 1, F.concat(F.lit("D:"), day, F.lit("0000+0100"))).when(k == 2, day)
    text = text.when(k == 3, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyy"), F.lit("1399"))).when(k == 4, F.concat(F.lit("D:"), day, F.lit(" "))).otherwise(F.concat(F.lit("D:"), day, F.lit("X")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", k.alias("k"), V.parsed_date(text).alias("d"))
    return rows.select("o_orderkey", "k", "d.repaired", "d.offset_min")


_PROGRAMS = [
    ("0 div", "0"), ("0 idiv", "0"), ("0 mod", "0"), ("neg sqrt", "0"), ("neg ln", "0"), ("0 mul log", "0"), ("pop 0 0 atan", "0"), ("true add", "x + 1"), ("pop 2.7 3 idiv", "0"), ("pop 2 7.9 bitshift", "256"),
    ("pop 1 { 5 } { 6 } ifelse", "5"), ("pop true 3 and", "1"), ("pop 7 -2 bitshift", "1"), ("pop -5 2 idiv", "-2"), ("pop -5 3 mod", "-2"), ("pop 6.5 round", "7"), ("pop -6.5 round", "-6"), ("pop -100 0 atan", "270"),
    ("pop 450 cos", "0"), ("pop -47.8 cvi", "-47"), ("pop true 1 eq { 1 } { 0 } ifelse", "0"), ("pop 52 not", "-53"), ("0.5 gt", "CASE WHEN x > 0.5 THEN 1 ELSE 0 END"), ("cvi 2 mod", "trunc(x) % 2"), ("pop 0 -1 exp", "0"),
    ("dup mul 1 add sqrt", "sqrt(x * x + 1)"), ("1 2 3 3 1 roll pop pop exch pop", "3"), ("3 copy pop pop", None), ("pop 99 1 and 7 or 2 xor", "5"),
]
_PROGRAMS = [(p, w) for p, w in _PROGRAMS if w is not None]


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(CAST({w} AS DOUBLE), 6) AS p{k}" for k, (_, w) in enumerate(_PROGRAMS)) + " FROM (SELECT *, l_quantity AS x FROM lineitem)")
def calculator_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-04: programs of every kind of operator over a line item's quantity, with results that need repair or conversion."""
    x = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(V.calculator("{ " + p + " }", x)[0], 6).alias(f"p{k}") for k, (p, _) in enumerate(_PROGRAMS)])


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, least(greatest(l_discount * 10, 0), 1) * 4 AS e, least(l_tax * 12.5, 1) AS f FROM lineitem),
    c AS (SELECT *, least(floor(e), 3) AS c, [0, 64, 255, 128, 32] AS t, [[10, 20], [30, 80]] AS g, least(floor(f), 0) AS d FROM s)
    SELECT l_orderkey, l_linenumber, round((t[CAST(c AS INT) + 1] * (1 - (e - c)) + t[CAST(c AS INT) + 2] * (e - c)) / 255, 9) AS one,
    round((1 - f) * ((1 - e / 4) * 10 + e / 4 * 20) / 255 + f * ((1 - e / 4) * 30 + e / 4 * 80) / 255, 9) AS two FROM c""")
def sampled_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-01: a table of five samples over one input, and one of two by two over two."""
    x, y = F.col("l_discount"), F.col("l_tax")
    one = V.sampled([x], [(0.0, 0.1)], [5], [0, 64, 255, 128, 32])
    two = V.sampled([x, y], [(0.0, 0.1), (0.0, 0.08)], [2, 2], [10, 20, 30, 80])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(one, 9).alias("one"), F.round(two, 9).alias("two"))


@query("""SELECT l_orderkey, l_linenumber, l_tax AS same, round(0.2 + sqrt(l_tax) * 0.6, 9) AS second, round(ln(l_quantity) + exp(-l_tax) + sin(l_quantity) * cos(l_tax) + atan2(l_tax, l_quantity) + acos(l_discount) + cbrt(l_quantity) + log10(l_extendedprice) + pow(l_quantity, 1.5), 6) AS math,
    round(l_quantity / 25.4 * 72 + l_quantity * 72 + l_quantity / 2.54 * 72 + l_quantity, 6) AS points FROM lineitem""")
def math_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-05, MTH-06, MTH-07: an array of an identity and an exponential function, the mathematical functions, lengths in four units."""
    q, t = F.col("l_quantity"), F.col("l_tax")
    both = V.each_of([None, lambda v: V.exponential(v, 0.2, 0.8, 0.5)], t)
    math = F.ln(q) + F.exp(-t) + F.sin(q) * F.cos(t) + F.atan2(t, q) + F.acos("l_discount") + F.cbrt(q) + F.log10("l_extendedprice") + F.pow(q, F.lit(1.5))
    points = sum((V.length(q, F.lit(u)) for u in ("mm", "in", "cm")), V.length(q, F.lit("pt")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", both[0].alias("same"), F.round(both[1], 9).alias("second"), F.round(math, 6).alias("math"), F.round(points, 6).alias("points"))


_BASE = "http://a.example/b/c/d?q"


@query(f"""WITH k AS (SELECT page_id, page_id % 9 AS k FROM pages), u AS (SELECT *, ['x/y', '/x', '../x', './x?n=', 'https://other.example/', '?n=', '#part', '//host/x', '../../../x'][k + 1] || page_id AS uri FROM k)
    SELECT page_id, uri, CASE k WHEN 0 THEN 'http://a.example/b/c/' || uri WHEN 1 THEN 'http://a.example' || uri WHEN 2 THEN 'http://a.example/b/x' || page_id WHEN 3 THEN 'http://a.example/b/c/x?n=' || page_id WHEN 4 THEN uri
    WHEN 5 THEN 'http://a.example/b/c/d' || uri WHEN 6 THEN '{_BASE}' || uri WHEN 7 THEN 'http:' || uri ELSE 'http://a.example/x' || page_id END AS resolved FROM u""")
def action_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14: links of each kind, by page, resolved against one base."""
    kinds = F.array(*[F.lit(x) for x in ("x/y", "/x", "../x", "./x?n=", "https://other.example/", "?n=", "#part", "//host/x", "../../../x")])
    uri = F.concat(F.element_at(kinds, (F.col("page_id") % 9 + 1).cast("int")), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", uri.alias("uri"), V.resolved_uri(uri, F.lit(_BASE)).alias("resolved"))


@query("""WITH s AS (SELECT doc_id, encode(text) AS b, strlen(text) AS n FROM documents)
    SELECT doc_id, sha256(b[1:n // 3] || b[n // 3 + n // 4 + 1:n]) AS digest, n // 4 = 0 AS whole FROM s""")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-02: the digest of a text's bytes but for a gap, as a signature's byte range leaves one out, and whether it covers all."""
    n, raw = F.octet_length("text"), F.encode("text", "UTF-8")
    first, gap = F.floor(n / 3).cast("int"), F.floor(n / 4).cast("int")
    covered = F.concat(F.substring(raw, F.lit(1), first), F.substring(raw, first + gap + 1, n))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(covered, 256).alias("digest"), (gap == 0).alias("whole"))


@query("""SELECT vec_id, round(embedding[3], 5) AS third, round(embedding[-1], 5) AS last, round(list_sum(embedding[2:4]), 4) AS part, len(embedding) AS n, list_contains(embedding, embedding[2]) AS has, CAST(list_position(embedding, embedding[2]) AS BIGINT) AS place, embedding[100000] IS NULL AS beyond FROM embeddings""")
def array_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-01: elements, slices, membership and places in arrays; beyond the end there is nothing."""
    e = F.col("embedding")
    part = F.aggregate(F.slice(e, 2, 3), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.element_at(e, 3), 5).alias("third"), F.round(F.element_at(e, -1), 5).alias("last"), F.round(part, 4).alias("part"), F.size(e).cast("long").alias("n"),
        F.array_contains(e, F.element_at(e, 2)).alias("has"), F.array_position(e, F.element_at(e, 2)).alias("place"), F.get(e, F.lit(99_999)).isNull().alias("beyond"),
    )


_GLYPHS = [("A", "A"), ("eacute", "é"), ("f_i", "fi"), ("uni00410042", "AB"), ("u1F600", "😀"), ("a.small", "a"), ("Euro", "€"), ("Ccaron", "Č"), ("nonsense", None), ("comma", ",")]


@query("SELECT p_partkey, [" + ", ".join(f"'{n}'" for n, _ in _GLYPHS) + "][p_partkey % 10 + 1] AS name, [" + ", ".join("NULL" if t is None else f"'{t}'" for _, t in _GLYPHS) + "][p_partkey % 10 + 1] AS text FROM part")
def glyph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: glyph names, by part key, and what they stand for."""
    from vellum.functions.content import glyph_text

    @F.pandas_udf("string")
    def texts(names: pd.Series) -> pd.Series:
        return names.map(glyph_text)

    names = F.array(*[F.lit(n) for n, _ in _GLYPHS])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int")).alias("name"))
    return rows.withColumn("text", texts("name"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'abc ' || c_custkey || ' ' || chr(1490) || chr(1489) || chr(1488) WHEN 1 THEN c_custkey || ' (' || chr(1489) || chr(1488) || ')' WHEN 2 THEN c_name ELSE 'x ' || c_custkey || ' ' || chr(1489) || chr(1488) || ' y' END AS shown FROM customer""")
def visual_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10: names with letters from right to left among others, numbers and brackets, in visual order."""
    from vellum.functions.bidi import visual_order

    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("abc אבג "), key)).when(k == 1, F.concat(F.lit("(אב) "), key)).when(k == 2, F.col("c_name")).otherwise(F.concat(F.lit("x "), key, F.lit(" אב y")))
    return table(spark, sf_dir, "customer").select("c_custkey", visual_order(text).alias("shown"))
