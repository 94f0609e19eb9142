"""Find over documents: folded, ordinal, non-overlapping matches with context, and steps between them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import COMPLEX, WORD_CLASS, folded, folded_map, page_text

CONTEXT = 32


def fold_query(needle: str, match_case: bool = False, match_marks: bool = False) -> str:
    """The words of a query joined by single blanks, folded."""
    return folded_map(" ".join(needle.split()), match_case, match_marks)[0]


def find_folded(text: str, needle: str, whole_word: bool, match_case: bool, match_marks: bool) -> list[tuple[int, int]]:
    """(start, length) in text of the matches of a folded needle, left to right, apart from each other. A hit that isn't a
    whole word is passed by one character."""
    plain, source = folded_map(text, match_case, match_marks)
    in_word = lambda k: 0 <= k < len(plain) and unicodedata.category(plain[k]) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mn", "Mc")
    out, at = [], plain.find(needle)
    while at >= 0:
        end = at + len(needle)
        if whole_word and (in_word(at - 1) or in_word(end)):
            at = plain.find(needle, at + 1)
            continue
        out.append((source[at], source[end - 1] + 1 - source[at]))
        at = plain.find(needle, end)
    return out


def _found(shown: Column, needle: str, whole_word: bool, options: dict) -> Column:
    """An array of struct(start, size). Texts of simple characters stay in generated code; the others alone go to Python."""
    query = fold_query(needle, **options)

    @F.pandas_udf("array<struct<start int, size int>>")
    def decomposed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "size": n} for a, n in find_folded(t, query, whole_word, **options)])

    plain, word = folded(shown, **options), f"[{WORD_CLASS}]"
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(plain, f"(?<!{word}){quoted}(?!{word})" if whole_word else quoted, -1)
    size = len(query)
    # Running start of each match: text before it, and the matches before it.
    starts = F.aggregate(
        F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.length(p)), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, n: F.struct((a["at"] + n + size).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")), lambda a: a["out"],
    )
    simple = F.when(plain.contains(F.lit(query)), F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("size"))))
    is_complex = shown.rlike("[^\\x00-\\x7F]" if options["match_marks"] else COMPLEX)
    return F.when(is_complex, decomposed(F.when(is_complex, shown))).otherwise(simple)


def matches(pages: DataFrame, keys: list[str], needle: str, whole_word: bool = False, match_case: bool = False, match_marks: bool = False) -> DataFrame:
    """keys, match_no (from 1), start (code points, from 0), text, context of each match in pages (keys, text), left to right.

    Context is CONTEXT characters to each side, cut back to a blank on each side if there is one, with an ellipsis where it
    was cut. An empty needle matches nothing. No shuffle: rows stay where they are, and matches come from one generator a row."""
    options = {"match_case": match_case, "match_marks": match_marks}
    rows = pages.select(*keys, page_text(F.col("text")).alias("shown"))
    if not fold_query(needle, **options):
        rows = rows.limit(0)
    rows = rows.select(*keys, "shown", F.posexplode(_found(F.col("shown"), needle, whole_word, options)).alias("k", "found"))
    rows = rows.select(*keys, "shown", "k", F.col("found.start").alias("start"), F.col("found.size").alias("size"))
    start, end = F.col("start"), F.col("start") + F.col("size")
    low, high = F.greatest(start - CONTEXT, F.lit(0)), F.least(end + CONTEXT, F.length("shown"))
    cut = F.when(low > 0, F.length(F.regexp_extract(F.substring("shown", low + 1, start - low), "(?s)^(.* )", 1))).otherwise(0)
    blank = F.when(high < F.length("shown"), F.locate(" ", F.substring("shown", end + 1, high - end))).otherwise(0)
    rows = rows.withColumn("low", low + cut).withColumn("high", F.when(blank > 0, end + blank - 1).otherwise(high))
    context = F.concat(F.when(F.col("low") > 0, "…").otherwise(""), F.substring("shown", F.col("low") + 1, F.col("high") - F.col("low")), F.when(F.col("high") < F.length("shown"), "…").otherwise(""))
    return rows.select(*keys, (F.col("k") + 1).alias("match_no"), "start", F.substring("shown", start + 1, F.col("size")).alias("text"), context.alias("context"))


def match_counts(pages: DataFrame, keys: list[str], needle: str, whole_word: bool = False, **options: bool) -> DataFrame:
    """keys, n_matches of pages with a match, counted within the row."""
    options = {"match_case": False, "match_marks": False} | options
    found = pages.select(*keys, F.size(_found(page_text(F.col("text")), needle, whole_word, options)).cast("long").alias("n_matches"))
    return found.where("n_matches > 0")


def moved_to(found: DataFrame, doc: str, rank: Column) -> DataFrame:
    """found (with_steps) with the current match moved to the one of this rank in each document; ranks beyond the last wrap."""
    return found.withColumn("is_current", F.col("rank") == F.pmod(rank - 1, F.col("n")) + 1)


def with_steps(found: DataFrame, doc: str, page: str, start_page: int = 0) -> DataFrame:
    """found with rank (in page order within a document), n, is_current (the first match at or behind start_page, wrapping),
    next_rank and previous_rank (wrapping)."""
    order = Window.partitionBy(doc).orderBy(page, "match_no")
    every = Window.partitionBy(doc)
    out = found.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(every))
    current = F.min(F.struct((F.col(page) < start_page).alias("behind"), F.col("rank"))).over(every)["rank"]
    return out.withColumn("is_current", F.col("rank") == current).withColumn("next_rank", F.col("rank") % F.col("n") + 1).withColumn("previous_rank", (F.col("rank") + F.col("n") - 2) % F.col("n") + 1)
