"""Property graphs as nodes (id, type, name, file, start, stop) and edges (source, target, type)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.scalars import last_folder
from tessera.operators.joins import overlapping, version_diff
from tessera.operators.ranges import running_sum
from tessera.operators.rounds import settled

BOTH, FORWARD = "both", "forward"
#: How impact follows edges by type: direction, and whether a node found is expanded.
FOLLOW = {"CALLS": (BOTH, True), "EXTENDS": (FORWARD, False), "METHOD_OVERRIDES": (BOTH, False)}


def first_wins(nodes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One node per key, the first in an order."""
    rest = [c for c in nodes.columns if c != key]
    return nodes.groupBy(key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def last_wins(edges: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in edges.columns if c != key]
    return edges.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without nodes, and without edges that touch them."""
    ids = gone.select(F.col("id")).distinct()
    left = edges
    for end in ("source", "target"):
        left = left.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


#: Rows up to which a frontier, or the numbers of seeds, are broadcast (at most about 100 bytes each).
BROADCAST_ROWS = 200_000
#: Seeds of a batch: the bits of a word.
WORD = 64


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def numbered(seeds: DataFrame) -> DataFrame:
    """``(seed, place, batch, bit)`` of distinct ids: bit ``place % 64`` of the word of batch ``place // 64``."""
    places = settled(seeds.select(F.col("id").alias("seed")).distinct().withColumn("place", F.monotonically_increasing_id()))
    return places.select("seed", "place", F.shiftright("place", 6).alias("batch"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))


def stepped(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """``(batch, id, down, up, calls)``: the words of a frontier (batch, at, bits) one hop on, by direction; calls: those that go on from there.

    Each direction is a join of the frontier with the edges as they are, a broadcast while the frontier is small.
    """
    known = F.col("type").isin(*FOLLOW)
    back = F.col("type").isin(*[k for k, (way, _) in FOLLOW.items() if way == BOTH])
    on = F.col("type").isin(*[k for k, (_, expand) in FOLLOW.items() if expand])
    none = F.lit(0).cast("long")
    word = lambda c: F.expr(f"bit_or({c})").alias(c)
    from_ = _small(frontier)

    def hop(own: DataFrame, here: str, there: str, down: bool) -> DataFrame:
        found = own.join(from_, F.col(here) == F.col("at"))
        ways = [F.col("bits"), none] if down else [none, F.col("bits")]
        return found.select("batch", F.col(there).alias("id"), ways[0].alias("down"), ways[1].alias("up"), F.when(on, F.col("bits")).otherwise(none).alias("calls"))

    both = hop(edges.filter(known), "source", "target", True).union(hop(edges.filter(back), "target", "source", False))
    return both.groupBy("batch", "id").agg(word("down"), word("up"), word("calls"))


def walk(edges: DataFrame, number: DataFrame, max_depth: int) -> DataFrame | None:
    """``(batch, id, down, up, calls, depth)``: for each node and batch of 64 seeds, which seeds first reach it at which depth, and by which direction.

    Calls are walked breadth first from every seed; what a call reaches goes on, what only another
    edge reaches doesn't. A node counts at the fewest hops; of two directions there the lesser counts.
    All seeds move together: a row is a node and a batch, whatever the number of seeds that reach it,
    and a hop is one aggregation by bit_or. It ends where a hop finds nothing, None if none does.
    """
    frontier = number.groupBy("batch", F.col("seed").alias("at")).agg(F.expr("bit_or(bit)").alias("bits"))
    seen = frontier.select("batch", F.col("at").alias("id"), F.col("bits").alias("found"), F.col("bits").alias("called"))
    hops = None
    for depth in range(1, max_depth + 1):
        before = seen.groupBy("batch", "id").agg(F.expr("bit_or(found)").alias("found"), F.expr("bit_or(called)").alias("called"))
        hop = stepped(edges, frontier).join(before, ["batch", "id"], "left")
        down, up = "down & ~coalesce(found, 0L)", "up & ~coalesce(found, 0L) & ~down"
        fresh = hop.select("batch", "id", F.expr(down).alias("down"), F.expr(up).alias("up"), F.expr("calls & ~coalesce(called, 0L)").alias("calls"), F.lit(depth).alias("depth"))
        fresh = settled(fresh.filter("(down | up | calls) <> 0"))
        if fresh.isEmpty():
            break
        hops = fresh if hops is None else hops.union(fresh)
        seen = seen.union(fresh.select("batch", "id", F.expr("down | up").alias("found"), F.col("calls").alias("called")))
        frontier = fresh.filter("calls <> 0").select("batch", F.col("id").alias("at"), F.col("calls").alias("bits"))
    return hops


def places_of(word: str) -> Column:
    """The places in a batch whose bits are set, as an array."""
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col(word), i) == 1)


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``(seed, id, depth, direction)``: what is within max_depth hops of each seed, by the fewest hops, as ``walk`` goes; up: to callers, down: to callees."""
    number = numbered(seeds)
    hops = walk(edges, number, max_depth)
    if hops is None:
        return number.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit("").alias("direction")).limit(0)
    way = lambda name: F.transform(places_of(name), lambda i: F.struct(i.alias("i"), F.lit(name).alias("direction")))
    each = hops.select("batch", "id", "depth", F.explode(F.concat(way("down"), way("up"))).alias("r"))
    named_ = each.withColumn("place", F.shiftleft("batch", 6) + F.col("r.i")).join(_small(number.select("seed", "place")), "place")
    return named_.select("seed", "id", "depth", "r.direction")


def one_hop(edges: DataFrame, symbol: str, names: DataFrame | None = None) -> DataFrame:
    """Callers, callees and overriders of a symbol, as sorted distinct last names."""
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    call, override = F.col("type") == "CALLS", F.col("type") == "METHOD_OVERRIDES"
    own = edges.filter((F.col("source") == symbol) | (F.col("target") == symbol))
    of = lambda condition, column: F.array_sort(F.collect_set(F.when(condition, last(F.col(column)))))
    return own.agg(of(call & (F.col("target") == symbol), "source").alias("callers"), of(call & (F.col("source") == symbol), "target").alias("callees"), of(override & (F.col("target") == symbol), "source").alias("overriders"))


def risk_of_callers(n: Column) -> Column:
    return F.when(n > 20, "high").when(n > 5, "medium").when(n > 0, "low").otherwise("none")


def risk_of_change(routes: Column, touched: Column) -> Column:
    return F.when((routes > 5) | (touched > 50), "high").when((routes > 0) | (touched > 10), "medium").otherwise("low")


def risk_of_diff(routes: Column, touched: Column, removed: Column, added: Column) -> Column:
    return F.when((removed > 0) | (routes > 5) | (touched > 50), "high").when((added > 5) | (routes > 0) | (touched > 10), "medium").otherwise("low")


def risk_of_total(n: Column) -> Column:
    return F.when(n > 50, "high").when(n > 10, "medium").when(n > 0, "low").otherwise("none")


def staleness(behind: Column, same_branch: Column) -> Column:
    return F.when(~same_branch, "other branch").when(behind == 0, "fresh").when(behind <= 2, "slight").when(behind <= 10, "medium").otherwise("severe")


def latest_version(versions: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("analyzed_at"), F.desc("version"))
    return versions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, n_out, n_in)`` of every node that an edge touches."""
    both = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def ask(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """The small query language: find_callers of X, find_callees of X, find_methods of C, symbols_in_file F, imports_of F, trace_process P.

    Names keep their case. Anything else raises.
    """
    words = text.split()
    verb, name = words[0].lower() if words else "", words[-1] if len(words) > 1 else ""
    named = nodes.filter(F.col("name") == name).select(F.col("id"))
    ends = {"find_callers": ("CALLS", "target", "source"), "find_callees": ("CALLS", "source", "target"), "find_methods": ("HAS_METHOD", "source", "target"), "trace_process": ("STEP_IN_PROCESS", "source", "target")}
    if verb in ends and name:
        kind, have, want = ends[verb]
        hit = edges.filter(F.col("type") == kind).join(named.withColumnRenamed("id", have), have, "left_semi").select(F.col(want).alias("id")).distinct()
        return hit.join(nodes, "id", "left").select("id", F.coalesce("name", "id").alias("name"))
    if verb == "symbols_in_file" and name:
        return nodes.filter(F.col("file") == name).select("id", "name")
    if verb == "imports_of" and name:
        own = nodes.filter(F.col("file") == name).select(F.col("id").alias("source"))
        return edges.filter("type = 'IMPORTS'").join(own, "source", "left_semi").select(F.col("target").alias("id")).distinct().join(nodes, "id", "left").select("id", F.coalesce("name", "id").alias("name"))
    raise ValueError(f"unknown query: {text}")


def weighted(edges: DataFrame) -> DataFrame:
    """``(a, b, w)`` of an undirected graph, each pair both ways; w: how many edges join them. Self loops are dropped."""
    pair = edges.filter("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return settled(pair.union(pair.select("b", "a")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w")))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of a partition ``(id, community)`` of all nodes that an edge to another touches; 0 without edges."""
    weight = weighted(edges)
    ends = weight.join(labels.select(F.col("id").alias("a"), F.col("community").alias("c")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("d")), "b")
    total = weight.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    each = ends.groupBy("c").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("c") == F.col("d"), F.col("w"))).alias("inside"))
    return each.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / total - (F.col("degree") / total) ** 2)).first()[0]


#: Gains of edges up to which a change counts as none.
NO_GAIN = 1e-9


def rounds_of_communities(edges: DataFrame) -> Iterator[DataFrame]:
    """The labels ``(id, community)`` at the start, each node its own, and after each round that raises modularity.

    Communities merge while a merge gains; then single nodes move while a move gains, and if any did,
    communities merge again. It ends where neither gains, not after a number of rounds. Every round that is
    given out raises modularity, for what merges or moves in it is chosen so that gains of a round add up.
    The whole graph is read for the first merges only. Only nodes with an edge to another community can move, so later rounds
    keep the edges of those and of their neighbours; what a move makes such a node is looked up then.
    """
    base = weighted(edges)
    total = base.agg(F.sum("w")).first()[0]
    labels = settled(base.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    yield labels
    if not total:
        return
    degree = settled(base.groupBy("a").agg(F.sum("w").alias("k")))
    base = settled(base.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b").select("a", "b", "w", "k", "kb"))
    for n, moved in enumerate(_merges(base, total), 1):
        labels = _renamed(labels, "community", moved)
        labels = settled(labels) if n % 4 == 0 else labels
        yield labels
    labels = settled(labels)
    sums = settled(degree.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("s")))
    names = sums.select(F.col("c").alias("community"), F.col("c").alias("name"))  # what the communities of labels are called by now
    ends, turn = _known(base, labels, _across(base, labels)), 0
    while True:
        changed = False
        while True:
            turn += 1
            moved = _node_moves(ends, sums, total, turn)
            if moved is None:
                break
            ends, sums = _after(ends, sums, moved)
            now, changed = _labels_now(labels, names, ends), True
            fresh = settled(ends.join(moved.select(F.col("id").alias("a")), "a", "left_semi").filter("c <> d").select(F.col("b").alias("a")).distinct().join(ends.select("a").distinct(), "a", "left_anti"))
            ends = ends if fresh.isEmpty() else settled(ends.union(_known(base, now, fresh, ends)))
            yield _labels_now(labels, names, ends)
        if not changed:
            return
        cut = ends.filter("c <> d").groupBy(F.col("c").alias("a"), F.col("d").alias("b")).agg(F.sum("w").alias("w"))
        weight = settled(cut.join(sums.select(F.col("c").alias("a"), F.col("s").alias("k")), "a").join(sums.select(F.col("c").alias("b"), F.col("s").alias("kb")), "b").select("a", "b", "w", "k", "kb"))
        for moved in _merges(weight, total):
            ends, names = settled(_renamed(_renamed(ends, "c", moved), "d", moved)), settled(_renamed(names, "name", moved))
            sums = settled(_renamed(sums, "c", moved).groupBy("c").agg(F.sum("s").alias("s")))
            yield _labels_now(labels, names, ends)


def _renamed(df: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """``df`` with the communities of a column replaced by what they merged into; moved: (a, to)."""
    return df.join(moved.filter("a <> to").select(F.col("a").alias(column), "to"), column, "left").select(*[F.coalesce("to", c).alias(c) if c == column else F.col(c) for c in df.columns])


def _across(base: DataFrame, labels: DataFrame) -> DataFrame:
    """``(a)``: the nodes with an edge to another community; no other can move."""
    own = lambda end, as_: labels.select(F.col("id").alias(end), F.col("community").alias(as_))
    return settled(base.select("a", "b").join(own("a", "c"), "a").join(own("b", "d"), "b").filter("c <> d").select("a").distinct())


def _known(base: DataFrame, labels: DataFrame, nodes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """``(a, b, w, k, c, d)``: all edges of nodes (a) and of their neighbours, with a's degree and the communities of both ends, but of nodes that ends has."""
    ids = nodes.union(base.join(_small(nodes), "a", "left_semi").select("b")).distinct()
    ids = settled(ids if ends is None else ids.join(ends.select("a").distinct(), "a", "left_anti"))
    edges = settled(base.select("a", "b", "w", "k").join(_small(ids), "a"))
    touched = settled(edges.select("a").union(edges.select("b")).distinct())
    own = settled(labels.join(_small(touched.withColumnRenamed("a", "id")), "id"))
    of = lambda end, as_: own.select(F.col("id").alias(end), F.col("community").alias(as_))
    return settled(edges.join(of("a", "c"), "a").join(of("b", "d"), "b").select("a", "b", "w", "k", "c", "d"))


def _labels_now(labels: DataFrame, names: DataFrame, ends: DataFrame) -> DataFrame:
    """The labels after moves, which ends has, and merges, which names has."""
    own = ends.select(F.col("a").alias("id"), "c").distinct()
    return labels.join(own, "id", "left").join(names, "community", "left").select("id", F.coalesce("c", "name").alias("community"))


def _after(ends: DataFrame, sums: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ends and sums after moves (id, c, to, k)."""
    to = lambda end, as_: moved.select(F.col("id").alias(end), F.col("to").alias(as_))
    both = ends.join(to("a", "na"), "a", "left").join(to("b", "nb"), "b", "left")
    change = moved.select("c", (-F.col("k")).alias("s")).union(moved.select("to", "k"))
    return settled(both.select("a", "b", "w", "k", F.coalesce("na", "c").alias("c"), F.coalesce("nb", "d").alias("d"))), settled(sums.union(change).groupBy("c").agg(F.sum("s").alias("s")))


def _merges(weight: DataFrame, total: float) -> Iterator[DataFrame]:
    """``(a, to, k)``, the merges of each round and the degrees of what they make, until no merge gains. weight: (a, b, w, k, kb) with the degrees of both ends.

    Each community wants the neighbour that it gains most with (ties to the least). One that no other wants moves there, and
    a quarter of the others by a hash of the round, if what they want doesn't move itself; of two that want only each other the lesser
    stays. Several may move to one: each then needs a gain even if all the others come too, or else
    only the best of them moves. Merged communities become the nodes of a smaller weighted graph, so a round is joins and
    sums of edges between communities.
    """
    turn = 0
    while True:
        turn += 1
        wants = settled(_wants(weight, total))
        moved = settled(_moved(wants, total, turn))
        if moved.isEmpty():
            if wants.isEmpty():
                return
            continue
        yield moved
        weight = _contracted(weight, moved)


def _wants(weight: DataFrame, total: float) -> DataFrame:
    """``(a, b, w, k, kb, gain)``: the neighbour b that each community gains most with, if it gains; both ends of a pair gain the same, so the best pair of all want each other."""
    gains = weight.withColumn("gain", F.col("w") - F.col("k") * F.col("kb") / total).filter(F.col("gain") > NO_GAIN)
    best = gains.groupBy("a").agg(F.min(F.struct((-F.col("gain")).alias("o"), "b", "w", "k", "kb")).alias("r"))
    return best.select("a", F.col("r.b").alias("b"), "r.w", "r.k", "r.kb", (-F.col("r.o")).alias("gain"))


def _moved(wants: DataFrame, total: float, turn: int) -> DataFrame:
    """``(a, to, k)``: the communities that move to the one they want, and those moved to, with the new degree of either's."""
    both = wants.join(wants.select(F.col("a").alias("b"), F.col("b").alias("back")), "b", "left")
    wanted = both.filter("back is null or back <> a").select(F.col("b").alias("a")).distinct().withColumn("wanted", F.lit(True))
    moves = (F.col("wanted").isNull()) | (F.pmod(F.xxhash64(F.col("a").cast("string"), F.lit(turn)), F.lit(4)) == 0)
    marked = wants.join(wanted, "a", "left").withColumn("moves", moves)
    other = marked.select(F.col("a").alias("b"), F.col("b").alias("back"), F.col("moves").alias("bmoves"))
    stays = ~F.coalesce("bmoves", F.lit(False)) | ((F.col("back") == F.col("a")) & (F.col("b") < F.col("a")))
    asks = settled(marked.filter("moves").join(other, "b", "left").filter(stays))
    crowd = asks.groupBy("b").agg(F.sum("k").alias("all"), F.max(F.struct("gain", "a")).alias("first"))
    checked = asks.join(crowd, "b").withColumn("sure", F.col("w") - F.col("k") * (F.col("kb") + F.col("all") - F.col("k")) / total > NO_GAIN)
    any_ = checked.groupBy("b").agg(F.max("sure").alias("any"))
    kept = settled(checked.join(any_, "b").filter(F.col("sure") | (~F.col("any") & (F.col("first.a") == F.col("a")))).select("a", "b", "k", "kb"))
    made = kept.groupBy("b").agg((F.sum("k") + F.max("kb")).alias("new"))
    return kept.join(made, "b").select("a", F.col("b").alias("to"), F.col("new").alias("k")).union(made.select("b", "b", "new"))


def merged(edges: DataFrame) -> DataFrame:
    """``(id, community)``: communities that grow by merging, in each round all pairs that gain most with each other, until no merge gains.

    Nothing is drawn and nodes don't move again, so SQL can say the same. A label is the least id of its members, as text; ``named`` joins single nodes.
    """
    base = weighted(edges)
    total = base.agg(F.sum("w")).first()[0]
    labels = settled(base.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    if not total:
        return named(labels)
    degree = settled(base.groupBy("a").agg(F.sum("w").alias("k")))
    weight = base.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b").select("a", "b", "w", "k", "kb")
    while True:
        wants = settled(_wants(weight, total))
        if wants.isEmpty():
            return named(labels)
        back = wants.select(F.col("a").alias("b"), F.col("b").alias("a"))
        pairs = wants.join(back, ["a", "b"], "left_semi").filter("a > b").select("a", "b", (F.col("k") + F.col("kb")).alias("k"))
        moved = settled(pairs.select("a", F.col("b").alias("to"), "k").union(pairs.select("b", "b", "k")))
        labels = settled(labels.join(moved.select(F.col("a").alias("community"), "to"), "community", "left").select("id", F.coalesce("to", "community").alias("community")))
        weight = _contracted(weight, moved)


def _contracted(weight: DataFrame, moved: DataFrame) -> DataFrame:
    """The edges (a, b, w, k, kb) between what is left after moves (a, to, k)."""
    new = lambda end, as_, k: moved.select(F.col("a").alias(end), F.col("to").alias(as_), F.col("k").alias(k))
    ends = weight.join(new("a", "na", "ka"), "a", "left").join(new("b", "nb", "kn"), "b", "left")
    ends = ends.select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "w", F.coalesce("ka", "k").alias("k"), F.coalesce("kn", "kb").alias("kb"))
    return settled(ends.filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("k").alias("k"), F.max("kb").alias("kb")))


def _node_moves(ends: DataFrame, sums: DataFrame, total: float, turn: int) -> DataFrame | None:
    """``(id, c, to, k)``: nodes that move from c to the community of a neighbour, None if none gains. ends: (a, b, w, k, c, d), at least all edges of all nodes with an edge to another community; sums: (c, s).

    Of neighbours that want to move only the one with the larger hash does, so links of a mover stay. It must gain even if its new
    community gets, and its old one loses, all that want to; if that holds for none, the best mover of each pair of communities moves alone.
    """
    links = ends.filter("c <> d").groupBy("a", "k", "c", "d").agg(F.sum("w").alias("w"))
    inner = F.col("k") - F.col("cut")  # without self loops, the rest of a node's degree is inside
    out = links.join(links.groupBy("a").agg(F.sum("w").alias("cut")), "a").join(sums.select("c", F.col("s").alias("sc")), "c").join(sums.select(F.col("c").alias("d"), F.col("s").alias("sd")), "d")
    apart = F.col("w") - inner
    gains = out.select("a", "c", "d", "k", "sc", "sd", apart.alias("apart"), (apart - F.col("k") * (F.col("sd") - F.col("sc") + F.col("k")) / total).alias("gain")).filter(F.col("gain") > NO_GAIN)
    best = gains.groupBy("a").agg(F.min(F.struct((-F.col("gain")).alias("o"), "d", "c", "k", "sc", "sd", "apart", "gain")).alias("r")).select("a", "r.*")
    wants = settled(best.withColumn("place", F.xxhash64(F.col("a").cast("string"), F.lit(turn))))
    if wants.isEmpty():
        return None
    near = ends.join(wants.select("a", "place"), "a").join(wants.select(F.col("a").alias("b"), F.col("place").alias("other")), "b").filter("other > place or (other = place and b > a)")
    free = settled(wants.join(near.select("a").distinct(), "a", "left_anti"))
    into, from_ = free.groupBy("d").agg(F.sum("k").alias("into")), free.groupBy("c").agg(F.sum("k").alias("out"))
    least = F.col("apart") - F.col("k") * (F.col("sd") - F.col("sc") + F.col("into") + F.col("out") - F.col("k")) / total
    moves = [F.col("a").alias("id"), "c", F.col("d").alias("to"), "k"]
    moved = settled(free.join(into, "d").join(from_, "c").filter(least > NO_GAIN).select(*moves))
    if not moved.isEmpty():
        return moved
    rank = F.struct("gain", "place", "a")
    top_to, top_from = free.groupBy("d").agg(F.max(rank).alias("t")), free.groupBy("c").agg(F.max(rank).alias("f"))
    return settled(free.join(top_to, "d").join(top_from, "c").filter((rank == F.col("t")) & (rank == F.col("f"))).select(*moves))


def communities(edges: DataFrame) -> DataFrame:
    """``(id, community)`` by modularity, over undirected edges weighted by how often they stand: the last labels of ``rounds_of_communities``.

    A label is the least id of its members, as text. Communities of one node become one, ``misc``, if there are two or more.
    """
    for labels in rounds_of_communities(edges):
        last = labels
    least = last.groupBy("community").agg(F.min("id").alias("least"))
    return named(last.join(least, "community").select("id", F.col("least").alias("community")))


def named(labels: DataFrame) -> DataFrame:
    """Communities of one node as one community, ``misc``, if there are two or more of them."""
    single = labels.groupBy("community").agg(F.count("*").alias("n")).filter("n = 1").select("community", F.lit(True).alias("single"))
    if single.count() < 2:
        return labels.select("id", F.col("community").cast("string").alias("community"))
    return labels.join(single, "community", "left").select("id", F.when(F.col("single"), "misc").otherwise(F.col("community").cast("string")).alias("community"))


def community_names(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(community, name, nodes)``: the folder that most of a community's nodes lie in, ties to the least; nodes: (id, file)."""
    folders = labels.join(nodes.select("id", last_folder(F.col("file")).alias("name")), "id").groupBy("community", "name").agg(F.count("*").alias("n"))
    return folders.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("o"), "name")).alias("b"), F.sum("n").alias("nodes")).select("community", "b.name", "nodes")


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(community, nodes, internal, cohesion)``: pairs of a community that an edge joins, in whichever direction, over its nodes; to three digits."""
    pairs = edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    inside = pairs.join(labels.select(F.col("id").alias("a"), F.col("community").alias("c")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("d")), "b").filter("c = d")
    sizes = labels.groupBy("community").agg(F.count("*").alias("nodes"))
    counts = inside.groupBy(F.col("c").alias("community")).agg(F.count("*").alias("internal"))
    return sizes.join(counts, "community", "left").select("community", "nodes", F.coalesce("internal", F.lit(0)).alias("internal"), F.round(F.coalesce("internal", F.lit(0)) / F.col("nodes"), 3).alias("cohesion"))


def processes(edges: DataFrame, entries: DataFrame, max_depth: int = 20, least: int = 3) -> DataFrame:
    """``(entry, id, step)``: the processes that ``reached`` keeps, their nodes numbered from 1 by depth then id, over ranges of rows."""
    rows = reached(edges, entries, max_depth, least)
    return running_sum(rows, ["entry"], ["depth", "id"], F.lit(1), "step").select("entry", "id", F.col("step").cast("int").alias("step"))


def reached(edges: DataFrame, entries: DataFrame, max_depth: int = 20, least: int = 3) -> DataFrame:
    """``(entry, id, depth)``: the process of an entry holds what its calls reach, if there are ``least`` of them with itself.

    Entries go by id, and one that the process of an earlier kept entry holds gets none. Which are kept is
    fixed in rounds: an entry is kept once every earlier entry whose process holds it is known to be dropped, and
    dropped once one of them is kept; the least open entry is always fixed, so it ends. Only kept entries are walked from, so
    rows are those of the result; what holds an entry is found by the least open entry that reaches a node.
    """
    calls = settled(edges.filter("type = 'CALLS' and source <> target").select("source", "target").distinct())
    left, found = _long(calls, entries.select("id").filter("id is not null").distinct(), max_depth, least), None
    while not left.isEmpty():
        sure = _unheld(calls, left, max_depth)
        own = _from_each(calls, sure, max_depth)
        found = own if found is None else found.union(own)
        left = settled(left.join(sure, "id", "left_anti").join(own.filter("entry < id").select("id").distinct(), "id", "left_anti"))
    return left.select(F.col("id").alias("entry"), "id", F.lit(0).alias("depth")) if found is None else found


def _long(calls: DataFrame, entries: DataFrame, max_depth: int, least: int) -> DataFrame:
    """The entries (id) that reach ``least`` nodes with themselves. No walk needs more hops than nodes, nor more calls of a node than nodes: if one has more, that is enough."""
    first = Window.partitionBy("source").orderBy("target")
    few = settled(calls.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") < least).select("source", "target"))
    have = frontier = settled(entries.select(F.col("id").alias("entry"), "id"))
    for _ in range(min(max_depth, least - 1)):
        hop = few.join(frontier.withColumnRenamed("id", "source"), "source").select("entry", F.col("target").alias("id")).distinct()
        have = settled(have.union(hop).distinct())
        done = have.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        frontier = hop.join(done, "entry", "left_anti").select("entry", "id")
    return settled(have.groupBy(F.col("entry").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("id"))


def _unheld(calls: DataFrame, left: DataFrame, max_depth: int) -> DataFrame:
    """The entries (id) of left that no lesser one of left reaches within max_depth calls.

    Those that no lesser one calls itself are looked at: calls are followed back from all of them at once, and along
    the calls found the least entry of left is carried forward, where it changed.
    """
    held = calls.join(left.withColumnRenamed("id", "source"), "source", "left_semi").filter("source < target").select(F.col("target").alias("id"))
    asked = settled(left.join(held.distinct(), "id", "left_anti"))
    known, frontier, into = asked, asked, calls.limit(0)
    for _ in range(max_depth):
        back = settled(calls.join(_small(frontier.withColumnRenamed("id", "target")), "target", "left_semi").select("source", "target"))
        into = into.union(back)
        frontier = settled(back.select(F.col("source").alias("id")).distinct().join(known, "id", "left_anti"))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    least = settled(left.join(known, "id", "left_semi").withColumn("low", F.col("id")))
    changed = least
    for _ in range(max_depth):
        hop = into.join(_small(changed.withColumnRenamed("id", "source")), "source").groupBy(F.col("target").alias("id")).agg(F.min("low").alias("low"))
        changed = settled(hop.join(least.withColumnRenamed("low", "old"), "id", "left").filter("old is null or low < old").select("id", "low"))
        if changed.isEmpty():
            break
        least = settled(least.union(changed).groupBy("id").agg(F.min("low").alias("low")))
    return settled(asked.join(least, "id").filter("low = id").select("id"))


def _from_each(calls: DataFrame, entries: DataFrame, max_depth: int) -> DataFrame:
    """``(entry, id, depth)``: what each entry reaches at which depth, itself at 0; along calls only, not against them."""
    every = frontier = settled(entries.select(F.col("id").alias("entry"), "id", F.lit(0).alias("depth")))
    for depth in range(1, max_depth + 1):
        at = _small(frontier.select("entry", F.col("id").alias("source")))
        hop = calls.join(at, "source").select("entry", F.col("target").alias("id")).distinct()
        frontier = settled(hop.join(every, ["entry", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        every = every.union(frontier)
    return every


#: Nodes and calls of one process up to which its trace is told; a larger one is refused, not cut.
TRACE_ROWS = 2_000_000
#: Nodes and calls that a group of processes holds on average.
TRACE_GROUP = 100_000


def traces(steps: DataFrame, calls: DataFrame, entries: DataFrame | None = None, max_depth: int = 20, most: int = TRACE_ROWS) -> DataFrame:
    """``(process, position, id, depth)``: the nodes of each process in depth-first order along the calls among them, no deeper than max_depth.

    steps: (process, id); calls: (source, target); entries: (process, entry). Called nodes go by id. A process whose entry is one of its
    nodes is walked from there; others from each node by id that no earlier one has reached. Whole processes are dealt to groups of about
    ``TRACE_GROUP`` rows, nodes cogrouped with calls; one of more than ``most`` rows raises, by a count before any is walked.
    """
    nodes = settled(steps.select("process", "id").distinct())
    inside = calls.select("source", "target").distinct().join(nodes.select("process", F.col("id").alias("source")), "source")
    inside = settled(inside.join(nodes.select("process", F.col("id").alias("target")), ["process", "target"], "left_semi").select("process", "source", "target"))
    sizes = nodes.select("process").union(inside.select("process")).groupBy("process").agg(F.count("*").alias("n"))
    rows, largest = sizes.agg(F.sum("n"), F.max(F.struct("n", "process"))).first()
    if largest and largest.n > most:
        raise ValueError(f"process {largest.process} has {largest.n} nodes and calls, more than {most}")
    first = nodes.limit(0) if entries is None else entries.select("process", F.col("entry").alias("id")).distinct()
    marked = nodes.join(first.withColumn("starts", F.lit(True)), ["process", "id"], "left").select("process", "id", F.coalesce("starts", F.lit(False)).alias("starts"))
    kind = {c: nodes.schema[c].dataType.simpleString() for c in ("process", "id")}

    def told(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        called: dict = {}
        for p, s, t in sorted(zip(links["process"], links["source"], links["target"], strict=True), reverse=True):
            called.setdefault((p, s), []).append(t)
        members: dict = {}
        for p, node, starts in sorted(zip(own["process"], own["id"], own["starts"], strict=True)):
            members.setdefault(p, ([], []))[0 if starts else 1].append(node)
        out: dict = {"process": [], "position": [], "id": [], "depth": []}
        for p, (starts, others) in members.items():
            seen: dict = {}
            for root in starts or others:
                stack = [(root, 0)]
                while stack:
                    node, depth = stack.pop()
                    if node not in seen and depth <= max_depth:
                        seen[node] = depth
                        stack += [(t, depth + 1) for t in called.get((p, node), ())]
            for c, values in zip(out, ([p] * len(seen), range(1, len(seen) + 1), seen, seen.values()), strict=True):
                out[c] += values
        return pd.DataFrame(out)

    group = F.pmod(F.xxhash64("process"), F.lit((rows or 0) // TRACE_GROUP + 1)).alias("_g")
    return marked.groupBy(group).cogroup(inside.groupBy(group)).applyInPandas(told, f"process {kind['process']}, position int, id {kind['id']}, depth int")


def overrides(extends: DataFrame, methods: DataFrame) -> DataFrame:
    """``(cls, method, overridden)``: the same-named method of the nearest class above, one for each method.

    extends: (child, parent), cycles allowed; methods: (cls, method). Ties at one distance go to the least class. Methods climb
    a class at a time and stop where they are found, so only those without any are carried to the top.
    """
    up = settled(extends.select(F.col("child").alias("at"), "parent").filter("at <> parent").distinct())
    have = settled(methods.select("cls", "method").distinct())
    seen = have.withColumn("at", F.col("cls"))
    climbing, found = seen, None
    while True:
        higher = climbing.join(up, "at").select("cls", "method", F.col("parent").alias("at")).distinct().join(seen, ["cls", "method", "at"], "left_anti")
        higher = settled(higher.join(have.select(F.col("cls").alias("at"), "method", F.lit(True).alias("hit")), ["at", "method"], "left"))
        if higher.isEmpty():
            break
        hit = settled(higher.filter("hit").groupBy("cls", "method").agg(F.min("at").alias("overridden")))
        found = hit if found is None else found.union(hit)
        climbing = higher.join(hit, ["cls", "method"], "left_anti").select("cls", "method", "at")
        seen = seen.union(climbing)
    return found if found is not None else have.select("cls", "method", F.col("cls").alias("overridden")).limit(0)


def method_implements(implements: DataFrame, methods: DataFrame) -> DataFrame:
    """``(cls, method, interface)``: methods that an interface of the class declares. implements: (child, interface); methods: (cls, method) of both."""
    of_interface = methods.select(F.col("cls").alias("interface"), "method")
    return methods.join(implements.select(F.col("child").alias("cls"), "interface").distinct(), "cls").join(of_interface, ["interface", "method"], "left_semi").select("cls", "method", "interface")


def symbols_in_ranges(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(change, id)``: the symbols that lie in changed ranges. nodes: (id, file, start, stop); ranges: (change, file, start, stop)."""
    spans = nodes.select("file", "id", "start", "stop")
    return overlapping(ranges.select("file", "change", "start", "stop"), spans, "file").select(F.col("range_change").alias("change"), F.col("span_id").alias("id")).distinct()


def impact_of_changes(nodes: DataFrame, edges: DataFrame, ranges: DataFrame, max_depth: int = 3) -> DataFrame:
    """``(change, symbols, upstream, downstream, routes, risk)`` of each change with symbols in its ranges.

    All symbols are walked at once, each only once however many changes touch it; what several symbols of a change reach counts once.
    Words of symbols become words of changes before they are shuffled, so pairs of a change and what it reaches are only ever counted.
    """
    touched = settled(symbols_in_ranges(nodes, ranges))
    number = numbered(touched)
    hops = walk(edges, number, max_depth)
    sizes = touched.groupBy("change").agg(F.count("*").alias("symbols"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = sizes.select("change", *[F.lit(0).alias(c) for c in ("upstream", "downstream", "routes")]).limit(0)
    if hops is not None:
        counts = _counts_of_changes(nodes, touched, number, hops)
    rows = sizes.join(counts, "change", "left").select("change", "symbols", zero("upstream"), zero("downstream"), zero("routes"))
    return rows.withColumn("risk", risk_of_change(F.col("routes"), F.col("upstream") + F.col("downstream")))


def _counts_of_changes(nodes: DataFrame, touched: DataFrame, number: DataFrame, hops: DataFrame) -> DataFrame:
    changes = numbered(touched.select(F.col("change").alias("id"))).select(F.col("seed").alias("change"), F.col("place").alias("cplace"), F.col("batch").alias("of"), F.col("bit").alias("own"))
    masks = touched.join(number, F.col("id") == F.col("seed")).join(changes, "change").groupBy("batch", "of", "own").agg(F.expr("bit_or(bit)").alias("mask"))
    reached = hops.groupBy("batch", "id").agg(F.expr("bit_or(down)").alias("down"), F.expr("bit_or(up)").alias("up"))
    hits = reached.join(_small(settled(masks)), "batch").filter("((down | up) & mask) <> 0")
    own = lambda c: F.when(F.expr(f"({c} & mask) <> 0"), F.col("own")).otherwise(F.lit(0).cast("long"))
    words = hits.select("of", "id", own("down").alias("down"), own("up").alias("up")).groupBy("of", "id").agg(F.expr("bit_or(down)").alias("down"), F.expr("bit_or(up)").alias("up"))
    kinds = words.join(nodes.filter("type = 'route'").select("id").distinct().withColumn("route", F.lit(True)), "id", "left")
    each = kinds.withColumn("any", F.expr("down | up")).select("of", "down", "up", "route", F.explode(places_of("any")).alias("i"))
    set_ = lambda c: F.getbit(F.col(c), F.col("i")) == 1
    sums = each.groupBy("of", "i").agg(F.count_if(set_("up")).alias("upstream"), F.count_if(set_("down")).alias("downstream"), F.count_if(F.col("route")).alias("routes"))
    return sums.withColumn("cplace", F.shiftleft("of", 6) + F.col("i")).join(changes.select("change", "cplace"), "cplace").select("change", "upstream", "downstream", "routes")


def compare_versions(base_nodes: DataFrame, base_edges: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """One row ``(added, removed, modified, upstream, downstream, new_upstream, new_downstream, routes, risk)`` of two versions of a graph.

    What added and modified symbols reach in the target is its impact; what modified ones don't reach in the base is new.
    """
    changes = settled(version_diff(base_nodes, nodes, ["id"], ["type", "name", "file", "start", "stop"]))

    def reach(e: DataFrame, seeds: DataFrame) -> DataFrame:
        """``(id, direction)`` of all seeds together: the words of a node only say whether any seed reaches it."""
        hops = walk(e, numbered(seeds), max_depth)
        if hops is None:
            return seeds.select("id", F.lit("").alias("direction")).limit(0)
        any_ = hops.groupBy("id").agg(F.max(F.col("down") != 0).alias("down"), F.max(F.col("up") != 0).alias("up"))
        ways = F.array_compact(F.array(F.when(F.col("down"), "down"), F.when(F.col("up"), "up")))
        return any_.select("id", F.explode(ways).alias("direction"))

    after = settled(reach(edges, changes.filter("change <> 'removed'").select("id")))
    before = reach(base_edges, changes.filter("change = 'modified'").select("id")).withColumn("old", F.lit(True))
    joined = after.join(before, ["id", "direction"], "left").join(nodes.select("id", "type"), "id", "left")
    up, down, new = F.col("direction") == "up", F.col("direction") == "down", F.col("old").isNull()
    counts = joined.agg(F.count_if(up).alias("upstream"), F.count_if(down).alias("downstream"), F.count_if(up & new).alias("new_upstream"), F.count_if(down & new).alias("new_downstream"), F.count_distinct(F.when(F.col("type") == "route", F.col("id"))).alias("routes"))
    kinds = changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")])
    both = kinds.withColumn("of", F.lit("diff")).join(counts.withColumn("of", F.lit("diff")), "of").drop("of")  # a row each
    return both.withColumn("risk", risk_of_diff(F.col("routes"), F.col("upstream") + F.col("downstream"), F.col("removed"), F.col("added")))


def lint_returns(name: Column, returns: Column) -> Column:
    """What is odd about a return annotation, as a sorted comma-joined list."""
    kinds = [
        F.when(returns.isNull() | (returns == ""), "missing"),
        F.when(returns.isin("Any", "object", "dict", "Dict[str, Any]"), "too broad"),
        F.when(returns.isin("Response", "JSONResponse"), "bare response"),
        F.when(returns == "None", "none"),
        F.when(returns.isin("str", "int", "float", "bool"), "primitive"),
    ]
    return F.array_join(F.array_sort(F.array_compact(F.array(*kinds))), ",")


def rename_preview(files: DataFrame, path: str, text: str, word: str) -> DataFrame:
    """``(path, line, column)`` of whole-word places of a name, both from 1. All of the name is plain text, whatever its signs."""
    if "\\E" in word:
        raise ValueError(f"no name: {word}")
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    pattern = rf"(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])"
    marked = lines.filter(F.rlike("line", F.lit(pattern))).withColumn("parts", F.split("line", pattern))
    ends = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.length(F.array_join(F.slice("parts", 1, i), word)) + 1)
    return marked.select("path", (F.col("n") + 1).alias("line"), F.explode(ends).alias("column"))
