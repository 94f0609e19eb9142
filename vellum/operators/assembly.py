"""Documents put together and taken apart, renamed keys, running lines, page labels, layers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import label, running_key
from vellum.operators.lookups import floor_join
from vellum.session import cut


def merge(parts: list[DataFrame], doc: str, page: str) -> DataFrame:
    """Pages of all parts in argument order, renumbered from 0 as new_page; a part may be given twice. Documents are dealt into
    ranges of (part, doc): counts of whole ranges, one row each, come to the driver, and within a range a window numbers the
    pages, so no task sees all of them."""
    tagged = None
    for k, p in enumerate(parts):
        own = p.select(F.lit(k).alias("part"), F.col(doc), F.col(page))
        tagged = own if tagged is None else tagged.unionByName(own)
    ranged = cut(tagged.repartitionByRange("part", doc).withColumn("_range", F.spark_partition_id()))
    counts = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = 0, []
    for k, n in counts:
        rows.append((k, before))
        before += n
    bases = F.broadcast(tagged.sparkSession.createDataFrame(rows, "_range int, _base long"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("part", doc, page)) - 1
    return ranged.withColumn("_own", own).join(bases, "_range").select("part", doc, page, (F.col("_base") + F.col("_own")).alias("new_page"))


def split(pages: DataFrame, doc: str, page: str, ranges: DataFrame) -> DataFrame:
    """A row to each range (range_no, first, beyond) and page in it, renumbered from 0; ranges may overlap."""
    hit = pages.join(F.broadcast(ranges), (F.col(page) >= F.col("first")) & (F.col(page) < F.col("beyond")))  # ranges are written in the call
    return hit.select("range_no", doc, page, (F.col(page) - F.col("first")).alias("new_page"))


def renamed(names: DataFrame, name: str, order: str) -> DataFrame:
    """names with new_name: in `order` each takes its name if it is free, else the first of name_1, name_2 and so on that is.

    Names that could take one another's place have one stem (the name without numbers behind underscores). Stems without
    numbered names count up in a window; the others go through a task in order, which keeps the names taken of one stem."""
    stem = F.regexp_replace(F.col(name), "(_[0-9]+)+$", "")
    rows = names.withColumn("_stem", stem)
    chains = rows.where(F.col("_stem") != F.col(name)).select("_stem").distinct()
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    plain = rows.join(chains, "_stem", "left_anti")
    plain = plain.withColumn("new_name", F.when(k == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), k.cast("string")))).drop("_stem")
    ordered = rows.join(chains, "_stem", "left_semi").select(*names.columns, "_stem").repartition("_stem").sortWithinPartitions("_stem", order)
    columns, at = names.columns, names.columns.index(name)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, tried = None, set(), {}
        for batch in batches:
            out = []
            for stem, old in zip(batch.column(len(columns)).to_pylist(), batch.column(at).to_pylist()):
                if stem != now:
                    now, taken, tried = stem, set(), {}
                new = old
                while new in taken:
                    tried[old] = tried.get(old, 0) + 1
                    new = f"{old}_{tried[old]}"
                taken.add(new)
                out.append(new)
            yield pa.record_batch([*batch.columns[:-1], pa.array(out, pa.string())], [*columns, "new_name"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in names.dtypes)
    return plain.select(*names.columns, "new_name").unionByName(ordered.mapInArrow(take, f"{schema}, new_name string"))


def inserted(pages: DataFrame, page: str, at: int, new: DataFrame) -> DataFrame:
    """pages with the rows of new (numbered from 0) put in before page `at`; numbers are made anew by arithmetic."""
    n = new.count()
    moved = pages.withColumn(page, F.when(F.col(page) >= at, F.col(page) + n).otherwise(F.col(page)))
    return moved.unionByName(new.withColumn(page, F.col(page) + at))


def removed(pages: DataFrame, page: str, first: int, beyond: int) -> DataFrame:
    """pages without first to beyond - 1; the ones behind move up."""
    left = pages.where((F.col(page) < first) | (F.col(page) >= beyond))
    return left.withColumn(page, F.when(F.col(page) >= beyond, F.col(page) - (beyond - first)).otherwise(F.col(page)))


def moved(page: Column, source: int, target: int) -> Column:
    """The new number of a page when page `source` is taken out and put in as page `target`."""
    between = F.when((page > source) & (page <= target), page - 1).when((page < source) & (page >= target), page + 1).otherwise(page)
    return F.when(page == source, F.lit(target)).otherwise(between)


def running_lines(lines: DataFrame, doc: str, page: str, line: str, reach: int = 4, least: int = 2) -> DataFrame:
    """doc, page, key of lines whose key (no white space, digits as #) stands on `least` other pages within `reach` pages.

    Pages of a key are counted in a range frame, so a key of a million pages costs a sort, not a self-join."""
    keyed = lines.select(doc, page, running_key(F.col(line)).alias("key")).where("key <> ''").distinct()
    near = Window.partitionBy(doc, "key").orderBy(page).rangeBetween(-reach, reach)
    return keyed.withColumn("_n", F.count(F.lit(1)).over(near) - 1).where(F.col("_n") >= least).drop("_n")


def page_labels(pages: DataFrame, doc: str, page: str, ranges: DataFrame) -> DataFrame:
    """pages with label; ranges: doc, start_page, style, prefix, first_number."""
    known = ranges.withColumn("_range", F.struct("start_page", "style", "prefix", "first_number"))
    found = floor_join(pages, known, doc, page, "start_page", "start_page", "_range")
    number = F.col("_range.first_number") + F.col(page) - F.col("_range.start_page")
    return found.withColumn("label", F.coalesce(label(F.col("_range.style"), F.col("_range.prefix"), number), (F.col(page) + 1).cast("string"))).drop("_range")


def is_visible(expression: list | str) -> Column:
    """A visibility expression, such as ["And", "a", ["Not", "b"]], over boolean columns named after the groups."""
    if isinstance(expression, str):
        return F.coalesce(F.col(expression), F.lit(True))
    operator, *operands = expression
    each = [is_visible(x) for x in operands]
    if operator == "Not":
        return ~each[0]
    out = each[0]
    for c in each[1:]:
        out = out & c if operator == "And" else out | c
    return out


def default_states(groups: DataFrame, base: str, on: list, off: list) -> DataFrame:
    """id, shown of layers (id, state): the configuration's base state (ON, OFF, or Unchanged: the state it has), then its ON list,
    then its OFF list. Lists are written in the configuration, so they go into the expression."""
    start = F.lit(base == "ON") if base in ("ON", "OFF") else F.coalesce("state", F.lit(True))
    return groups.select("id", F.when(F.col("id").isin(off or [None]), False).when(F.col("id").isin(on or [None]), True).otherwise(start).alias("shown"))


def switched_on(states: DataFrame, radio: DataFrame, turned: DataFrame) -> DataFrame:
    """id, shown of states (id, shown) after the layers of turned (id) were turned on: the rest of each radio-button collection
    (collection, id) that one of them is in goes off."""
    hit = radio.join(turned, "id", "left_semi").select("collection").distinct()
    off = radio.join(hit, "collection", "left_semi").select("id").distinct().join(turned, "id", "left_anti").withColumn("_off", F.lit(True))
    out = states.join(off, "id", "left").join(turned.select("id").distinct().withColumn("_on", F.lit(True)), "id", "left")
    return out.select("id", F.when(F.col("_on"), True).when(F.col("_off"), False).otherwise(F.col("shown")).alias("shown"))


def annotation_shown(flags: Column, known: Column, printing: bool) -> Column:
    """By the flags Invisible 1, Hidden 2, Print 4, NoView 32: hidden ones never, invisible ones not if their kind is unknown; in
    print those to be printed, on screen those not barred from it."""
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    return ~has(2) & ~(has(1) & ~known) & (has(4) if printing else ~has(32))


def policy(states: Column, kind: str) -> Column:
    """AllOn, AnyOn, AnyOff or AllOff over an array of booleans; an empty one is visible."""
    test = {"AllOn": lambda a: F.forall(a, lambda x: x), "AnyOn": lambda a: F.exists(a, lambda x: x), "AnyOff": lambda a: F.exists(a, lambda x: ~x), "AllOff": lambda a: F.forall(a, lambda x: ~x)}[kind]
    return (F.size(states) == 0) | test(states)


def folded_state(base: Column, changes: Column) -> Column:
    """An ordered list of ON, OFF and Toggle applied to a state."""
    return F.aggregate(changes, base, lambda s, c: F.when(c == "ON", True).when(c == "OFF", False).when(c == "Toggle", ~s).otherwise(s))
