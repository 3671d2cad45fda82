import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G, ranges, trees as T

EDGE = "source string, target string, type string"


def random_edges(rng, nodes, n):
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice(["CALLS", "CALLS", "EXTENDS", "METHOD_OVERRIDES", "IMPORTS"])) for _ in range(n)]


def walked(edges, seed, depth):
    """Calls breadth first, both ways; other edges are seen but not followed: {id: (hops, direction)}."""
    level, called, found = {seed}, {seed}, {}
    for d in range(1, depth + 1):
        ways, calls = {}, set()
        for s, t, k in edges:
            for x, y, way in ((s, t, "down"), *([(t, s, "up")] if k in ("CALLS", "METHOD_OVERRIDES") else [])):
                if k != "IMPORTS" and x in level:
                    ways[y] = min(way, ways.get(y, "up"))
                    if k == "CALLS":
                        calls.add(y)
        found |= {y: (d, way) for y, way in ways.items() if y not in found and y != seed}
        level = calls - called
        called |= level
    return found


@pytest.mark.parametrize(("nodes", "n", "seeds", "small"), [(30, 60, 2, 200_000), (120, 160, 110, 200_000), (60, 70, 60, 0)])
def test_impact_equals_breadth_first_search(spark, monkeypatch, nodes, n, seeds, small):
    monkeypatch.setattr(G, "BROADCAST_ROWS", small)
    rng = random.Random(nodes)
    edges = random_edges(rng, nodes, n)
    ids = [f"n{i}" for i in range(seeds)]
    rows = G.impact(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(s,) for s in ids + ids], "id string"), 4).collect()
    assert len(rows) == len({(r.seed, r.id) for r in rows})
    assert {(r.seed, r.id): (r.depth, r.direction) for r in rows} == {(s, y): v for s in ids for y, v in walked(edges, s, 4).items()}


def test_a_walk_ends_where_nothing_is_found(spark, monkeypatch):
    steps = []
    real = G.stepped
    monkeypatch.setattr(G, "stepped", lambda *a: steps.append(1) or real(*a))
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS")], EDGE)
    assert G.impact(edges, spark.createDataFrame([("a",)], "id string"), 10).count() == 2
    assert len(steps) == 3
    assert G.impact(edges, spark.createDataFrame([("z",)], "id string"), 10).count() == 0


def test_rows_of_a_walk_do_not_grow_with_seeds(spark):
    """Ten times the seeds that reach the same nodes take the same rows, up to a word of them."""
    edges = [(f"s{i}", "hub", "CALLS") for i in range(64)] + [("hub", f"t{i}", "EXTENDS") for i in range(300)]
    frame = spark.createDataFrame(edges, EDGE)
    rows = []
    for n in (6, 60):
        seeds = spark.createDataFrame([(f"s{i}",) for i in range(n)], "id string").coalesce(1)
        rows.append(G.walk(frame, G.numbered(seeds), 2).count())
    assert rows[1] <= rows[0] + 64 and G.impact(frame, seeds, 2).count() == 60 * (1 + 300 + 63)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_change_counts_equal_sets(spark, seed):
    rng = random.Random(seed)
    edges = random_edges(rng, 40, 55)
    nodes = [(f"n{i}", rng.choice(["route", "function"]), f"n{i}", rng.choice("fg"), i, i + 3) for i in range(40)]
    changes = [(c, rng.choice("fg"), a := rng.randrange(40), a + rng.randrange(6)) for c in range(80)]  # noqa: F821
    got = G.impact_of_changes(spark.createDataFrame(nodes, "id string, type string, name string, file string, start long, stop long"), spark.createDataFrame(edges, EDGE), spark.createDataFrame(changes, "change long, file string, start long, stop long"), 2).collect()
    want = {}
    for c, f, a, b in changes:
        own = [i for i, _, _, g, s, e in nodes if g == f and s <= b and e >= a]
        hits = {(y, way) for s in own for y, (_, way) in walked(edges, s, 2).items()}
        if own:
            want[c] = (len(own), sum(w == "up" for _, w in hits), sum(w == "down" for _, w in hits), len({y for y, _ in hits if dict((n[0], n[1]) for n in nodes)[y] == "route"}))
    assert {r.change: (r.symbols, r.upstream, r.downstream, r.routes) for r in got} == want


def greedy_processes(edges, entries, max_depth, least):
    out, held = {}, set()
    for e in sorted(entries):
        if e in held:
            continue
        depth, level = {e: 0}, [e]
        for d in range(1, max_depth + 1):
            level = sorted({t for s, t in edges if s in level} - depth.keys())
            depth |= {t: d for t in level}
        if len(depth) >= least:
            out[e] = sorted(depth, key=lambda x: (depth[x], x))
            held |= depth.keys()
    return out


@pytest.mark.parametrize(("seed", "max_depth"), [(1, 1), (2, 2), (3, 3), (4, 20), (5, 2)])
def test_processes_equal_a_loop_in_order(spark, seed, max_depth):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(90):02}", f"n{rng.randrange(90):02}") for _ in range(110)}
    entries = [f"n{i:02}" for i in range(90) if rng.random() < 0.8]
    got = {}
    for r in G.processes(spark.createDataFrame([(*e, "CALLS") for e in edges], EDGE), spark.createDataFrame([(e,) for e in entries], "id string"), max_depth).orderBy("step").collect():
        got.setdefault(r.entry, []).append(r.id)
    assert got == greedy_processes(edges, entries, max_depth, 3)


@pytest.mark.parametrize(("max_depth", "least"), [(4, 1), (4, 5), (2, 6), (0, 1)])
def test_processes_of_other_sizes_over_cycles(spark, max_depth, least):
    rng = random.Random(least)
    edges = {(rng.randrange(50), rng.randrange(50)) for _ in range(70)}
    entries = [i for i in range(60) if rng.random() < 0.8]
    got = {}
    for r in G.processes(spark.createDataFrame([(*e, "CALLS") for e in edges], "source long, target long, type string"), spark.createDataFrame([(e,) for e in [*entries, *entries, None]], "id long"), max_depth, least).orderBy("step").collect():
        got.setdefault(r.entry, []).append(r.id)
    assert got == greedy_processes(edges, entries, max_depth, least)


def test_only_kept_entries_are_walked_from(spark, monkeypatch):
    """Each node of a chain is an entry: pairs of an entry and what it reaches are read for the two kept ones alone."""
    written, real = [], G.settled
    monkeypatch.setattr(G, "settled", lambda df, *a: written.append(real(df, *a)) or written[-1])
    chain = spark.createDataFrame([(i, i + 1, "CALLS") for i in range(40)], "source long, target long, type string")
    steps = G.processes(chain, chain.select(F.col("source").alias("id")))
    assert {r.entry: r["count"] for r in steps.groupBy("entry").count().collect()} == {0: 21, 21: 20}
    assert max(df.count() for df in written) <= 3 * 41


def test_traces_of_small_processes_share_a_group(spark, monkeypatch):
    """Of 300 processes, each alone in its own group before; in groups of one row each they come out the same."""
    steps = spark.range(300).selectExpr("id div 3 as process", "id")
    calls = spark.range(300).selectExpr("id as source", "id + 1 as target")
    first = G.traces(steps, calls)
    assert "FlatMapCoGroupsInPandas" in (plan := first._jdf.queryExecution().toString()) and "pmod(xxhash64(process" in plan
    want = [(i // 3, i % 3 + 1, i, i % 3) for i in range(300)]
    assert sorted(tuple(r) for r in first.collect()) == want
    monkeypatch.setattr(G, "TRACE_GROUP", 1)
    assert sorted(tuple(r) for r in G.traces(steps, calls).collect()) == want


def quality(edges, label):
    m, degree, inside = len(edges), {}, 0
    for a, b in edges:
        degree[label[a]] = degree.get(label[a], 0) + 1
        degree[label[b]] = degree.get(label[b], 0) + 1
        inside += label[a] == label[b]
    return inside / m - sum((k / (2 * m)) ** 2 for k in degree.values())


def greedy(edges):
    """Merge the pair of communities that gains most until none gains."""
    label = {n: n for e in edges for n in e}
    while True:
        now, best = quality(edges, label), (1e-12, None)
        for a, b in {tuple(sorted((label[x], label[y]))) for x, y in edges if label[x] != label[y]}:
            gain = quality(edges, {n: a if c == b else c for n, c in label.items()}) - now
            if gain > best[0]:
                best = gain, (a, b)
        if best[1] is None:
            return label
        label = {n: best[1][0] if c == best[1][1] else c for n, c in label.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merges_reach_the_modularity_of_a_greedy_search(spark, seed):
    rng = random.Random(seed)
    edges = []
    for group in range(5):
        edges += [(f"g{group}-{rng.randrange(9)}", f"g{group}-{rng.randrange(9)}") for _ in range(18)]
    edges += [(f"g{rng.randrange(5)}-{rng.randrange(9)}", f"g{rng.randrange(5)}-{rng.randrange(9)}") for _ in range(14)] + [("hub", f"leaf{i}") for i in range(12)]
    edges = [(a, b) for a, b in edges if a != b]
    frame = spark.createDataFrame(edges, "source string, target string")
    values = []
    for labels in G.rounds_of_communities(frame):
        label = {r.id: r.community for r in labels.collect()}
        values.append(quality(edges, label))
        assert G.modularity(frame, labels) == pytest.approx(values[-1])
    assert values == sorted(values) and len(set(values)) == len(values)
    assert values[-1] >= 0.95 * quality(edges, greedy(edges))
    final = {r.id: r.community for r in G.communities(frame).collect()}
    assert quality(edges, final) == pytest.approx(values[-1]) and all(final[c] == c for c in set(final.values()))


def test_communities_of_odd_graphs(spark):
    assert G.communities(spark.createDataFrame([], "source string, target string")).count() == 0
    assert G.communities(spark.createDataFrame([("a", "a")], "source string, target string")).count() == 0
    pair = G.communities(spark.createDataFrame([(2, 1), (1, 2)], "source long, target long")).collect()
    assert {(r.id, r.community) for r in pair} == {(1, "1"), (2, "1")}


def test_single_moves_read_the_edges_near_other_communities_alone(spark, monkeypatch):
    """On a path of 600 nodes, and no node is left whose move to a neighbour's community gains."""
    edges = [(i, i + 1) for i in range(600)] + [(600 + i, 600 + (i + 1) % 4) for i in range(4)]
    read, real = [], G._node_moves
    monkeypatch.setattr(G, "_node_moves", lambda first, *a: read.append(first.count()) or real(first, *a))
    label = {r.id: r.community for r in G.communities(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert read and max(read) < len(edges)
    now = quality(edges, label)
    for a, b in [*edges, *((b, a) for a, b in edges)]:
        if label[a] != label[b]:
            assert quality(edges, {**label, a: label[b]}) <= now + 1e-12


def random_tree(rng, n):
    return [(i, rng.randrange(i) if i and rng.random() < 0.95 else None, rng.choice("xyz")) for i in range(n)]


def brute_labels(tree):
    children = {}
    ids = {i for i, _, _ in tree}
    for i, p, name in tree:
        children.setdefault(p if p in ids else None, []).append((name, i))
    out, n = {}, 0
    stack = [(c[1], 0, False) for c in sorted(children.get(None, []), reverse=True)]
    while stack:
        i, depth, leaving = stack.pop()
        if leaving:
            out[i] = (*out[i], n)
            continue
        n += 1
        out[i] = (depth, n)
        stack.append((i, depth, True))
        stack += [(c[1], depth + 1, False) for c in sorted(children.get(i, []), reverse=True)]
    return out


@pytest.mark.parametrize("levels", [32, 0])
def test_labels_equal_a_walk(spark, levels):
    rng = random.Random(7)
    tree = [*random_tree(rng, 150), *((200 + i, 149 if i == 0 else 199 + i, "q") for i in range(20)), (300, 999, "lost parent")]
    frame = spark.createDataFrame(tree, "id long, parent_id long, name string").repartition(5)
    got = {r.id: (r.depth, r.start, r.stop) for r in T.intervals(frame, order=["name"], levels=levels).collect()}
    assert got == brute_labels(tree)
    assert T.intervals(frame.limit(0), levels=levels).count() == 0


def test_a_chain_of_any_depth(spark):
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    labels = T.intervals(chain)
    assert labels.filter("start <> id + 1 or depth <> id or stop <> 100000").count() == 0 and labels.count() == n


def test_cycles_are_refused(spark):
    schema = "id long, parent_id long"
    for rows in ([(1, 2), (2, 1)], [(0, None), (1, 1)], [(0, None), *((i, i - 1 if i > 1 else 60) for i in range(1, 61))]):
        for levels in (32, 0):
            with pytest.raises(ValueError, match="cycle"):
                T.intervals(spark.createDataFrame(rows, schema), levels=levels)
        with pytest.raises(ValueError, match="cycle"):
            T.closure(spark.createDataFrame(rows, schema))
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], schema)
    assert T.closure(deep).count() == 5050


def test_counts_of_subtrees(spark):
    rng = random.Random(9)
    tree = random_tree(rng, 120)
    items = [(rng.randrange(130),) for _ in range(500)]
    rows = T.depth_first(spark.createDataFrame(tree, "id long, parent_id long, name string"), spark.createDataFrame(items, "folder long"), "folder", order=["name"]).collect()
    labels = brute_labels(tree)
    for r in rows:
        depth, start, stop = labels[r.id]
        inside = {i for i, (_, s, _) in labels.items() if start <= s <= stop}
        assert (r.position, r.depth, r.direct, r.total, r.children) == (start, depth, sum(f == r.id for f, in items), sum(f in inside for f, in items), sum(p == r.id for _, p, _ in tree))


def test_running_sums_go_over_ranges(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 50) as k", "id", "id % 7 as v").repartition(6)
    got = ranges.running_sum(rows, ["k"], ["id"], F.col("v"), "s").collect()
    total = {}
    for r in sorted(got, key=lambda r: r.id):
        total[r.k] = total.get(r.k, 0) + r.v
        assert r.s == total[r.k]
    assert len(got) == 3000


def told(nodes, calls, entry, max_depth):
    seen = {}

    def visit(n, depth):
        if n in seen or depth > max_depth:
            return
        seen[n] = depth
        for t in sorted(t for s, t in calls if s == n and t in nodes):
            visit(t, depth + 1)

    for n in [entry] if entry in nodes else sorted(nodes):
        visit(n, 0)
    return list(seen.items())


@pytest.mark.parametrize("max_depth", [2, 20])
def test_traces_equal_a_recursive_walk(spark, max_depth):
    rng = random.Random(11)
    calls = {(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(60)}
    steps = {p: {f"n{rng.randrange(25):02}" for _ in range(15)} for p in "abc"}
    entries = {"a": sorted(steps["a"])[3], "b": "elsewhere"}
    frame = spark.createDataFrame([(p, n) for p, ns in steps.items() for n in ns], "process string, id string")
    edges = spark.createDataFrame(sorted(calls), "source string, target string")
    got = {}
    for r in G.traces(frame, edges, spark.createDataFrame(sorted(entries.items()), "process string, entry string"), max_depth).orderBy("position").collect():
        got.setdefault(r.process, []).append((r.id, r.depth))
    assert got == {p: told(ns, calls, entries.get(p), max_depth) for p, ns in steps.items()}
    with pytest.raises(ValueError, match="more than 10"):
        G.traces(frame, edges, None, max_depth, most=10)
    assert G.traces(frame.limit(0), edges).count() == 0


def test_merged_communities_of_two_triangles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4), (7, 7)]
    found = {r.id: r.community for r in G.merged(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert found == {1: "1", 2: "1", 3: "1", 4: "4", 5: "4", 6: "4"}
    assert G.merged(spark.createDataFrame([], "source long, target long")).count() == 0
