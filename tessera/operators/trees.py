"""Trees as (id, parent) tables: interval labels, closure, counts, copies, moves, and folders from paths.

A parent that isn't in the table counts as none. Ids are unique.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ranges import running_sum
from tessera.operators.rounds import settled

#: Levels down to which a tree is labelled level by level; beyond, by the ranks of its tour.
LEVELS = 32


def _numbered(tree: DataFrame, id_col: str, parent_col: str, order: Sequence[str]) -> DataFrame:
    """``(place, up, id, parent, o0, o1, ...)``: nodes and their parents as numbers, up is -1 for roots; the columns they are ordered by."""
    sort = [F.col(c).alias(f"o{i}") for i, c in enumerate([*order, id_col])]
    nodes = settled(tree.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), *sort))
    above = nodes.select(F.col("id").alias("parent"), F.col("place").alias("up"))
    return settled(nodes.join(above, "parent", "left").withColumn("up", F.coalesce("up", F.lit(-1).cast("long"))))


def intervals(tree: DataFrame, id_col: str = "id", parent_col: str = "parent_id", order: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """``(id, parent, depth, start, stop)`` of every node: its number in depth-first order, from 1, and the last number below it.

    Siblings, and roots, go by the order columns, then by id. A node is below another if its start lies in
    the other's interval, so no pairs are needed. A tree of up to ``levels`` levels takes three small joins a
    level. A deeper one is a list of entering and leaving each node, whose ranks come from pointer doubling: about
    log2 of the nodes joins, whatever the depth. Raises if there is a cycle.
    """
    nodes = _numbered(tree, id_col, parent_col, order)
    sort = [c for c in nodes.columns if c.startswith("o")]
    found = _by_levels(nodes, sort, levels)
    labels = found if found is not None else _by_tour(nodes, sort)
    return nodes.join(labels, "place").select("id", "parent", "depth", "start", "stop")


def _by_levels(nodes: DataFrame, sort: list[str], levels: int) -> DataFrame | None:
    """``(place, depth, start, stop)``; None if there are more levels. Sizes are summed upwards, starts handed down."""
    level = [settled(nodes.filter("up = -1").select("place", "up"))]
    while not level[-1].isEmpty():
        if len(level) > levels:
            return None
        level.append(settled(nodes.select("place", "up").join(level[-1].select(F.col("place").alias("up")), "up", "left_semi").select("place", "up")))
    level.pop()
    if sum(x.count() for x in level) < nodes.count():
        raise ValueError("a cycle")
    sizes = [None] * len(level)
    for d in reversed(range(len(level))):
        one = level[d].withColumn("size", F.lit(1).cast("long"))
        if d + 1 < len(level):
            below = sizes[d + 1].groupBy(F.col("up").alias("place")).agg(F.sum("size").alias("more"))
            one = one.join(below, "place", "left").select("place", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        sizes[d] = settled(one)
    every = None
    for d, s in enumerate(sizes):
        part = s.select("place", "size", F.lit(d).alias("depth"))
        every = part if every is None else every.union(part)
    if every is None:
        return nodes.select("place", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop")).limit(0)
    before = running_sum(nodes.select("place", "up", *sort).join(every, "place"), ["up"], sort, F.col("size"), "through")
    before = settled(before.select("place", "up", "depth", "size", (F.col("through") - F.col("size")).alias("earlier")))
    last, out = None, None
    for d in range(len(level)):
        here = before.filter(F.col("depth") == d)
        if last is None:
            now = here.withColumn("start", F.col("earlier") + 1)
        else:
            now = here.join(last.select(F.col("place").alias("up"), F.col("start").alias("above")), "up").withColumn("start", F.col("above") + 1 + F.col("earlier"))
        last = settled(now.select("place", "depth", "start", (F.col("start") + F.col("size") - 1).alias("stop")))
        out = last if out is None else out.union(last)
    return out


def _by_tour(nodes: DataFrame, sort: list[str]) -> DataFrame:
    """``(place, depth, start, stop)`` from the tour: 2 * place enters a node, 2 * place + 1 leaves it."""
    ranked = settled(running_sum(nodes.select("place", "up", *sort), ["up"], sort, F.lit(1).cast("long"), "n").select("place", "up", "n"))
    first = ranked.filter("n = 1").select(F.col("up").alias("place"), (2 * F.col("place")).alias("child"))
    after = ranked.select("up", (F.col("n") - 1).alias("n"), (2 * F.col("place")).alias("sibling"))
    enter = ranked.join(first, "place", "left").select((2 * F.col("place")).alias("e"), F.coalesce("child", 2 * F.col("place") + 1).alias("next"), F.lit(1).cast("long").alias("enters"), F.lit(1).cast("long").alias("deeper"))
    up = F.when(F.col("up") >= 0, 2 * F.col("up") + 1)
    leave = ranked.join(after, ["up", "n"], "left").select((2 * F.col("place") + 1).alias("e"), F.coalesce("sibling", up).alias("next"), F.lit(0).cast("long").alias("enters"), F.lit(-1).cast("long").alias("deeper"))
    n = nodes.count()
    live, done, rounds = settled(enter.union(leave)), None, 0
    while True:
        ended = live.filter("next is null")
        done = ended if done is None else done.union(ended)
        going = live.filter("next is not null")
        if going.isEmpty():
            break
        if rounds > math.log2(2 * n) + 2:
            raise ValueError("a cycle")
        hop = done.union(going).select(F.col("e").alias("next"), F.col("next").alias("after"), F.col("enters").alias("m"), F.col("deeper").alias("d"))
        live, rounds = settled(going.join(hop, "next").select("e", F.col("after").alias("next"), (F.col("enters") + F.col("m")).alias("enters"), (F.col("deeper") + F.col("d")).alias("deeper"))), rounds + 1
    # sums to the end of the tour: enters from here on, and minus the depth before
    entered = done.filter("e % 2 = 0").select((F.col("e") / 2).cast("long").alias("place"), (-F.col("deeper")).cast("int").alias("depth"), (n + 1 - F.col("enters")).alias("start"))
    left = done.filter("e % 2 = 1").select(F.floor(F.col("e") / 2).alias("place"), (n - F.col("enters")).alias("stop"))
    return settled(entered.join(left, "place"))


def closure(tree: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """``(ancestor, id, depth)`` of every node with itself and each node above it: as many rows as the depths add up to.

    Pointers double: in each round the known paths are joined end to end, so a tree of depth d
    takes about log2(d) joins; each round is settled before the next. Raises if there is a cycle, which single
    pointers show before any path is held.
    """
    edges = tree.filter(F.col(parent_col).isNotNull()).select(F.col(parent_col).alias("ancestor"), F.col(id_col).alias("id"))
    edges = settled(edges.join(tree.select(F.col(id_col).alias("ancestor")), "ancestor", "left_semi"))
    _refuse_cycles(edges)
    paths, reach = edges.withColumn("depth", F.lit(1)), 1
    while True:
        step = paths.filter(F.col("depth") == reach).select(F.col("ancestor").alias("top"), F.col("id").alias("ancestor"), F.col("depth").alias("above"))
        if step.isEmpty():
            break
        longer = paths.join(step, "ancestor").select(F.col("top").alias("ancestor"), "id", (F.col("depth") + F.col("above")).alias("depth"))
        paths, reach = paths.union(settled(longer)), reach * 2
    own = tree.select(F.col(id_col).alias("ancestor"), F.col(id_col).alias("id"), F.lit(0).alias("depth"))
    return own.union(paths)


def _refuse_cycles(edges: DataFrame) -> None:
    """Raise if (ancestor, id) has a cycle: a pointer that still leads on after more steps than there are edges."""
    jump, reach, n = edges, 1, edges.count()
    while reach <= n:
        jump = settled(jump.join(jump.select(F.col("ancestor").alias("top"), F.col("id").alias("ancestor")), "ancestor").select(F.col("top").alias("ancestor"), "id"))
        if jump.isEmpty():
            return
        reach *= 2
    if not jump.isEmpty():
        raise ValueError("a cycle")


def subtree_sums(labels: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """``(id, total)`` of every node: the sum of value over it and all below it, a difference of two running sums. labels: as of ``intervals``; own: ``(id, value)``."""
    placed = labels.join(own.select("id", F.col(value).alias("v")), "id", "left").select("id", "start", "stop", F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.lit(0).alias("all"))
    sums = settled(running_sum(placed, ["all"], ["start"], F.col("v"), "through"))
    last = sums.select(F.col("start").alias("stop"), F.col("through").alias("last"))
    return sums.join(last, "stop").select("id", (F.col("last") - F.col("through") + F.col("v")).alias("total"))


def subtree_counts(tree: DataFrame, items: DataFrame, item_folder: str, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """``(id, direct, total, children)`` of every folder: its own items, those below it too, and its folders."""
    return depth_first(tree, items, item_folder, id_col, parent_col).select("id", "direct", "total", "children")


def depth_first(tree: DataFrame, items: DataFrame, item_folder: str, id_col: str = "id", parent_col: str = "parent_id", order: Sequence[str] = ()) -> DataFrame:
    """``(position, id, parent, depth, direct, total, children)`` of every folder: the tree as it is shown, a row each, with its counts."""
    own = items.groupBy(F.col(item_folder).alias("id")).agg(F.count("*").alias("direct"))
    labels = settled(intervals(tree, id_col, parent_col, order))
    children = tree.groupBy(F.col(parent_col).alias("id")).agg(F.count("*").alias("children"))
    joined = labels.join(own, "id", "left").join(subtree_sums(labels, own, "direct"), "id", "left").join(children, "id", "left")
    return joined.select(F.col("start").alias("position"), "id", "parent", "depth", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "total", "children")])


def below(tree: DataFrame, root, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """The labels of root and of all below it: one interval."""
    labels = settled(intervals(tree, id_col, parent_col))
    top = labels.filter(F.col("id") == root).select("start", "stop").first()
    return labels.filter(F.col("start").between(top.start, top.stop)) if top else labels.limit(0)


def subtree(tree: DataFrame, root, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """The rows of root and of all below it."""
    return tree.join(below(tree, root, id_col, parent_col).select(F.col("id").alias(id_col)), id_col, "left_semi")


def copy(tree: DataFrame, root, new_id: Column, new_parent, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Copies of root's subtree: ids by new_id, parents remapped, the root below new_parent."""
    rows = subtree(tree, root, id_col, parent_col)
    ids = rows.select(F.col(id_col).alias(parent_col), new_id.alias("_parent"))
    parent = F.when(F.col(id_col) == root, F.lit(new_parent)).otherwise(F.col("_parent"))
    return rows.join(ids, parent_col, "left").withColumn(parent_col, parent).withColumn(id_col, new_id).select(*tree.columns)


def copy_rows(rows: DataFrame, copied: DataFrame, column: str, new_id: Column, id_col: str = "id") -> DataFrame:
    """Copies of the rows that belong to copied ones, with new ids: items of copied folders, and again parts of copied items.

    copied: ``(old, new)`` ids of what was copied; column: whose it is. All other columns stay as they are.
    """
    ids = copied.select(F.col("old").alias(column), F.col("new").alias("new_owner"))
    return rows.join(ids, column).withColumn(column, F.col("new_owner")).withColumn(id_col, new_id).select(*rows.columns)


def move(tree: DataFrame, node, new_parent, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """The tree with node below new_parent; raises if that is node itself or below it."""
    if not below(tree, node, id_col, parent_col).filter(F.col("id") == new_parent).isEmpty():
        raise ValueError(f"{new_parent} is below {node}")
    return tree.withColumn(parent_col, F.when(F.col(id_col) == node, F.lit(new_parent)).otherwise(F.col(parent_col)))


def ancestors(path: Column) -> Column:
    """All folders of a path, from the outermost."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def folders_of(paths: DataFrame, column: str) -> DataFrame:
    """``(id, parent_id)`` of all folders and files of a table of paths; the root is the empty path."""
    every = paths.select(F.explode(F.concat(ancestors(F.col(column)), F.array(column))).alias("id")).distinct()
    parent = F.when(F.col("id").contains("/"), F.regexp_replace("id", "/[^/]*$", "")).otherwise("")
    root = paths.sparkSession.createDataFrame([("", None)], "id string, parent_id string")
    return every.select("id", parent.alias("parent_id")).union(root)
