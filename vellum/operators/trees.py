"""Hierarchies: closure, qualified names, inheritance, order, role chains, pruning, copies.

Trees are climbed by pointer jumping: each round a node takes over what its pointer's node knows and points where that one
points, so a tree of depth d takes log2(d) rounds of joins, each cut at a checkpoint. No depth and no number of rows is too
large, and nodes of a cycle, which never reach a root, are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut


def climbed(nodes: DataFrame, inherited: list[str] | None = None, opened: str | None = None, ordinal: str | None = None) -> DataFrame:
    """id, depth (0 for a root), fqn (names from the root joined by a dot) of nodes (id, parent_id, name) that a root leads to.

    inherited: columns whose nulls are filled from the nearest ancestor that has a value. opened: a boolean column; visible tells
    whether all ancestors are open. ordinal: a number among siblings; place, the ordinals from the root on, sorts in preorder.
    A null name counts as none: the node has its parent's name. A node with an unknown parent is left out."""
    inherited = inherited or []
    state = nodes.select(
        "id", F.col("parent_id").alias("to"), F.lit(0).alias("depth"), F.when(F.col("name").isNull(), F.array().cast("array<string>")).otherwise(F.array("name")).alias("names"), *inherited,
        (F.col(opened) if opened else F.lit(True)).alias("own_open"), F.lit(True).alias("visible"), F.array(F.col(ordinal).cast("long") if ordinal else F.lit(0).cast("long")).alias("place"),
    )
    rounds = 1 + math.ceil(math.log2(max(2, nodes.count())))
    for _ in range(rounds + 1):
        up = state.select(*(F.col(c).alias(f"up_{c}") for c in state.columns))
        met = state.join(up, state["to"] == up["up_id"], "left").where("`to` is null or up_id is not null")
        on = F.col("to").isNotNull()
        state = cut(
            met.select(
                "id", F.when(on, F.col("up_to")).alias("to"), F.when(on, F.col("depth") + F.col("up_depth") + 1).otherwise(F.col("depth")).alias("depth"),
                F.when(on, F.concat("up_names", "names")).otherwise(F.col("names")).alias("names"), *(F.coalesce(c, f"up_{c}").alias(c) for c in inherited), "own_open",
                F.when(on, F.col("visible") & F.col("up_own_open") & F.col("up_visible")).otherwise(F.col("visible")).alias("visible"), F.when(on, F.concat("up_place", "place")).otherwise(F.col("place")).alias("place"),
            )
        )
        if state.where("`to` is not null").isEmpty():
            break
    state = state.where("`to` is null")
    return state.select("id", "depth", F.array_join("names", ".").alias("fqn"), *inherited, *(["visible"] if opened else []), *(["place"] if ordinal else []))


def qualified(nodes: DataFrame) -> DataFrame:
    """id, depth, fqn of nodes (id, parent_id, name)."""
    return climbed(nodes)


def selected(nodes: DataFrame, names: list[str] | None, exclude: bool = False) -> DataFrame:
    """id, fqn of the named nodes and all below them; exclude: of all others. None names all."""
    tree = qualified(nodes)
    if names is None:
        return tree.select("id", "fqn") if not exclude else tree.select("id", "fqn").limit(0)
    hit = F.lit(False)
    for n in names:
        hit = hit | (F.col("fqn") == n) | F.col("fqn").startswith(n + ".")
    return tree.where(~hit if exclude else hit).select("id", "fqn")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id of all nodes that edges (src, dst) reach from roots (id); cycles end where a node is known already. Each round is cut
    at a checkpoint, and what is known is one table, so plans don't grow."""
    known = cut(roots.select("id").distinct())
    fresh = known
    while not fresh.isEmpty():
        fresh = edges.join(fresh.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti")
        fresh = cut(fresh)
        known = cut(known.union(fresh))
    return known


def garbage(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of objects (id) that nothing leads to from roots: what a full save drops."""
    return objects.join(reachable(edges, roots), "id", "left_anti")


def copied(edges: DataFrame, roots: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """A deep copy of what roots lead to: (id, new_id), each object copied once however many refer to it, numbered from `first`
    in the order of the ids; and the copied references (src, dst) between new ids. Numbers come from counts of ranges of
    ids, so no task orders all objects."""
    ids = cut(reachable(edges, roots).repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    before, rows = first, []
    for r in sorted(ids.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row a partition
        rows.append((r["part"], before))
        before += r["n"]
    bases = F.broadcast(edges.sparkSession.createDataFrame(rows, "part int, base long"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    new = ids.withColumn("own", own).join(bases, "part").select("id", (F.col("base") + F.col("own")).alias("new_id"))
    of = lambda c: new.select(F.col("id").alias(c), F.col("new_id").alias(f"new_{c}"))
    links = edges.join(of("src"), "src").join(of("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    return new, links


def roles(role_map: DataFrame, standard: list[str]) -> DataFrame:
    """type, role: each type's chain in role_map (type, target) followed to its end. Without a cycle the last type if it is
    standard; in a cycle the first standard type behind the start, else the start if it is standard; else null.

    A chain has as many steps as there are types at most; each step is one join, cut at a checkpoint."""
    steps = role_map.select("type", "target").dropDuplicates(["type"])
    open_ = steps.select("type", F.array("type").alias("path"), F.col("type").alias("here"))
    ends, known = None, F.array(*[F.lit(s) for s in standard])
    for _ in range(steps.count() + 2):
        met = open_.join(steps.select(F.col("type").alias("here"), F.col("target").alias("next")), "here", "left")
        met = cut(met.select("type", "path", "here", "next", (F.col("next").isNotNull() & ~F.coalesce(F.array_contains("path", F.col("next")), F.lit(False))).alias("goes_on")))
        last = met.where("not goes_on").select("type", "path", "here", F.col("next").isNotNull().alias("looped"))
        ends = last if ends is None else ends.union(last)
        open_ = met.where("goes_on").select("type", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("here"))
        if open_.isEmpty():
            break
    behind = F.filter(F.slice("path", F.lit(2), F.size("path")), lambda x: F.array_contains(known, x))
    is_standard = lambda c: F.array_contains(known, F.col(c))
    role = F.when(~F.col("looped"), F.when(is_standard("here"), F.col("here"))).otherwise(F.coalesce(F.get(behind, F.lit(0)), F.when(is_standard("type"), F.col("type"))))
    return ends.select("type", role.alias("role"))


def pruned(tree: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of tree (id, fqn) that are kept (id) or have a kept descendant. Each kept item lists its ancestors' names, so no
    pair of items is compared."""
    names = F.split("fqn", "\\.")
    up = tree.join(kept.select("id"), "id", "left_semi").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "."))).alias("fqn")).distinct()
    return tree.join(up, "fqn", "left_semi")
