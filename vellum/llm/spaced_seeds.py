"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a mask that looks at some positions of a window of tokens and ignores the others. Every window of a text is
hashed through each mask; equal hashes of a document and a benchmark item are a hit on one diagonal (offset between the two
texts). Substituted words at ignored positions don't break a hit. Around each hit the whole item is laid along its
diagonal, and the best stretch of WINDOW tokens (of the whole item if it is shorter) decides: with a share of EQUAL equal
tokens or more, the document holds a passage of the item. An item under LEAST tokens must be there word for word.

The masks miss none of these: whichever 4 of 16 tokens differ, one of LONG lies on equal ones somewhere; for items of 15, of
which 3 may differ, too (take a 16th that differs). Whichever 3 of 12 differ, one of SHORT does, and so in items of 12 to 14,
of which 3 may differ. Items under LEAST have one mask, their whole length. Texts are hashed through the masks that the
benchmark's items need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import broadcast_below, stored

#: Looked-at positions of each mask, for items of WINDOW - 1 tokens or more and for shorter ones of LEAST or more.
LONG = ("11101011", "11001000111", "110100010011", "1101001011", "11100000001011", "110001111")
SHORT = ("111011", "110100011", "11001011", "110111")
LEAST = 12
WINDOW = 16
EQUAL = 0.75
#: Rows up to which the benchmark's seeds, its items, or the documents with hits are broadcast; beyond, joins shuffle.
MOST_SEEDS = 2_000_000
MOST_ITEMS = 100_000
MOST_HITS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of lower-cased runs of letters and digits."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def masks(n: int) -> tuple[str, ...]:
    """The masks of an item of n tokens."""
    return LONG if n >= WINDOW - 1 else SHORT if n >= LEAST else ("1" * n,) if n else ()


def seeds(h: Column, i: Column, through: list[str]) -> Column:
    """Hashes through each mask in turn of the window of tokens h that begins at i; null where the window ends behind h."""
    hashed = lambda mask: F.xxhash64(F.lit(int(mask, 2)), *[F.get(h, i + k) for k, c in enumerate(mask) if c == "1"])
    return F.array(*[F.when(i + len(mask) <= F.size(h), hashed(mask)) for mask in through])


def _placed(df: DataFrame, through: list[str], *keys: str) -> DataFrame:
    """keys, seed, at: a row to each window and mask; the text itself isn't copied along.

    The windows are rows before they are hashed, so generated code hashes them; explode_outer, since a plain explode has a
    filter on its array inferred, which would work out the tokens a second time."""
    starts = F.when(F.size("h") >= min(map(len, through)), F.sequence(F.lit(0), F.size("h") - min(map(len, through))))
    df = df.select(*keys, tokens(F.col("text")).alias("h")).select(*keys, "h", F.explode_outer(starts).alias("at"))
    df = df.where(F.col("at").isNotNull()).select(*keys, "at", F.explode_outer(seeds(F.col("h"), F.col("at"), through)).alias("seed"))
    return df.where(F.col("seed").isNotNull())


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of the text, so that rows that repeat a doc_id are told apart."""
    return docs.withColumn("text_key", F.xxhash64("text"))


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, diagonal, share: the verified overlaps of docs (doc_id, text) with benchmark (item_id, text).

    Null texts and texts without tokens have none; repeated rows count once; items without an item_id are found as others
    are, with a null item_id."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    length = F.least(F.size(tokens(F.col("text"))), F.lit(WINDOW - 1))  # longer items have the same masks
    lengths: dict[tuple[str, ...], list[int]] = {}
    for n in sorted(r["n"] for r in items.select(length.alias("n")).distinct().collect()):  # WINDOW rows at most
        lengths.setdefault(masks(n), []).append(n)
    parts = [_placed(items.where(length.isin(ns)).withColumn("item_key", F.xxhash64("text")), list(m), "item_id", "item_key") for m, ns in lengths.items() if m]
    rows = _keyed(docs.select("doc_id", "text")).where(F.col("text").isNotNull())
    if not parts:
        nothing = rows.crossJoin(items).limit(0)
        return nothing.select("doc_id", "text_key", "item_id", F.lit(0).alias("diagonal"), F.lit(0.0).alias("share"))
    known = broadcast_below(reduce(DataFrame.unionByName, parts).withColumnRenamed("at", "item_at").distinct(), MOST_SEEDS)
    found = _placed(rows, list(dict.fromkeys(mask for m in lengths for mask in m)), "doc_id", "text_key").join(known, "seed")
    hits = stored(found.select("doc_id", "text_key", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "seed-hits")
    with_hits = broadcast_below(hits.select("doc_id", "text_key").distinct(), MOST_HITS)
    texts = rows.join(with_hits, [rows["doc_id"].eqNullSafe(with_hits["doc_id"]), rows["text_key"] == with_hits["text_key"]], "left_semi")
    texts = texts.select("doc_id", "text_key", tokens(F.col("text")).alias("doc_tokens"))
    item_tokens = broadcast_below(items.select(F.col("item_id").alias("of_item"), F.xxhash64("text").alias("of_key"), tokens(F.col("text")).alias("item_tokens")), MOST_ITEMS)
    laid = hits.join(item_tokens, F.col("item_id").eqNullSafe(F.col("of_item")) & (F.col("item_key") == F.col("of_key"))).join(texts, [hits["doc_id"].eqNullSafe(texts["doc_id"]), hits["text_key"] == texts["text_key"]])
    laid = laid.select(hits["doc_id"], hits["text_key"], "item_id", "diagonal", "doc_tokens", "item_tokens")
    equal = F.transform(F.col("item_tokens"), lambda x, p: F.when((p + F.col("diagonal") >= 0) & (F.get(F.col("doc_tokens"), p + F.col("diagonal")) == x), 1).otherwise(0))
    laid = laid.withColumn("equal", equal).drop("doc_tokens", "item_tokens")
    needed = F.when(F.size("equal") < LEAST, 1.0).otherwise(EQUAL)
    size = F.least(F.lit(WINDOW), F.size("equal"))
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - size + 1), lambda s: F.aggregate(F.slice(F.col("equal"), s, size), F.lit(0), lambda a, x: a + x))
    share = F.array_max(sums) / size
    return laid.select("doc_id", "text_key", "item_id", "diagonal", share.alias("share"), needed.alias("needed")).where("share >= needed").drop("needed").distinct()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_passages, item_ids (ascending, comma-joined, items without an id left out), max_share of every
    row of docs. Null texts hold nothing; rows that repeat a doc_id are judged each by its own text; an empty table gives an
    empty one."""
    found = passages(docs, benchmark).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("ids"), F.max("share").alias("most"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "n", "ids", "most")
    rows = _keyed(docs.select("doc_id", "text")).select("doc_id", "text_key")
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return out.select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_passages"), F.coalesce("ids", F.lit("")).alias("item_ids"), F.coalesce("most", F.lit(0.0)).alias("max_share"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no passage of benchmark. Rows without text stay."""
    bad = stored(passages(docs, benchmark).select(F.col("doc_id").alias("bad_doc"), F.col("text_key").alias("bad_key")).distinct(), "contaminated")
    bad = broadcast_below(bad, MOST_HITS)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs["text"]) == bad["bad_key"]), "left_anti")
