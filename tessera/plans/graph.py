"""A graph of orders that call parts (whole lineitem) and extend customers, as nodes and edges; some orders are routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators.rounds import settled
from tessera.plans.registry import query
from tessera.sources.tables import table

_EDGES = """edges AS (SELECT DISTINCT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target, 'CALLS' AS type FROM lineitem
UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'EXTENDS' FROM orders)"""
_NODES = """nodes AS (SELECT 'o:' || o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'route' ELSE 'function' END AS type, 'order_' || o_orderkey AS name, o_orderpriority AS file, o_orderkey % 1000 AS start, o_orderkey % 1000 + 3 AS stop FROM orders
UNION ALL SELECT 'p:' || p_partkey, 'function', p_name, p_brand, p_partkey, p_partkey + p_size % 3 FROM part UNION ALL SELECT 'c:' || c_custkey, 'class', c_name, c_mktsegment, c_custkey, c_custkey + 9 FROM customer)"""
_STEPS = """steps AS (SELECT source AS a, target AS b, 'down' AS direction, type = 'CALLS' AS expand FROM edges UNION SELECT target, source, 'up', true FROM edges WHERE type = 'CALLS')"""


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _nodes(spark, sf_dir):
    def of(t, id_, kind, name, file, start, stop):
        return table(spark, sf_dir, t).select(id_.alias("id"), kind.alias("type"), name.alias("name"), F.col(file).alias("file"), start.alias("start"), (start + stop).alias("stop"))

    kind = F.when(F.col("o_orderstatus") == "P", "route").otherwise("function")
    orders = of("orders", _id("o:", "o_orderkey"), kind, _id("order_", "o_orderkey"), "o_orderpriority", F.col("o_orderkey") % 1000, F.lit(3))
    parts = of("part", _id("p:", "p_partkey"), F.lit("function"), F.col("p_name"), "p_brand", F.col("p_partkey"), F.col("p_size") % 3)
    return orders.union(parts).union(of("customer", _id("c:", "c_custkey"), F.lit("class"), F.col("c_name"), "c_mktsegment", F.col("c_custkey"), F.lit(9)))


def _edges(spark, sf_dir, distinct: bool = True):
    """Calls and classes of orders. Walks may have calls as often as they stand: words of bits don't count them."""
    lines = table(spark, sf_dir, "lineitem").select(_id("o:", "l_orderkey").alias("source"), _id("p:", "l_partkey").alias("target"), F.lit("CALLS").alias("type"))
    return (lines.distinct() if distinct else lines).union(table(spark, sf_dir, "orders").select(_id("o:", "o_orderkey"), _id("c:", "o_custkey"), F.lit("EXTENDS")))


def _walk(seeds: str, depth: int, h: str = "h", steps: str = "steps") -> str:
    parts = [f"{h}0 AS ({seeds})"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, id FROM {h}{i}" for i in range(d))
        parts.append(f"""{h}{d} AS (SELECT h.seed, s.b AS id, min(s.direction) AS direction, bool_or(s.expand) AS expand FROM {h}{d - 1} h JOIN {steps} s ON s.a = h.id WHERE h.expand
  AND NOT EXISTS (SELECT 1 FROM ({seen}) x WHERE x.seed = h.seed AND x.id = s.b) GROUP BY 1, 2)""")
    return ", ".join(parts)


_ONE = _walk("SELECT 'p:1' AS seed, 'p:1' AS id, '' AS direction, true AS expand", 3)
_HOPS = " UNION ALL ".join(f"SELECT seed, id, {d} AS depth, direction FROM h{d}" for d in (1, 2, 3))


@query("bfs_impact", f"WITH {_EDGES}, {_STEPS}, {_ONE} SELECT * FROM ({_HOPS})")
def bfs_impact(spark, sf_dir):
    return G.impact(_edges(spark, sf_dir, False), spark.createDataFrame([("p:1",)], "id string"), 3)


_RANGES = "ranges AS (SELECT s_suppkey AS change, 'Brand#' || (1 + s_suppkey % 5) || (1 + s_nationkey % 5) AS file, s_suppkey * 3 AS start, s_suppkey * 3 + 40 * (s_suppkey % 4) AS stop FROM supplier)"
_HITS = "SELECT seed, id, direction FROM h1 UNION ALL SELECT seed, id, direction FROM h2"


@query("change_impact", f"""
WITH {_EDGES}, {_NODES}, {_STEPS}, {_RANGES}, touched AS (SELECT DISTINCT change, id FROM ranges r JOIN nodes n ON n.file = r.file AND n.start <= r.stop AND n.stop >= r.start),
{_walk("SELECT DISTINCT id AS seed, id, '' AS direction, true AS expand FROM touched", 2)}, hits AS ({_HITS}),
reached AS (SELECT DISTINCT change, h.id AS hit, direction FROM touched t JOIN hits h ON h.seed = t.id),
counts AS (SELECT change, count(*) FILTER (WHERE direction = 'up') AS upstream, count(*) FILTER (WHERE direction = 'down') AS downstream, count(DISTINCT hit) FILTER (WHERE type = 'route') AS routes FROM reached LEFT JOIN nodes ON id = hit GROUP BY 1)
SELECT change, count(*) AS symbols, coalesce(any_value(upstream), 0) AS upstream, coalesce(any_value(downstream), 0) AS downstream, coalesce(any_value(routes), 0) AS routes,
  CASE WHEN coalesce(any_value(routes), 0) > 5 OR coalesce(any_value(upstream + downstream), 0) > 50 THEN 'high' WHEN coalesce(any_value(routes), 0) > 0 OR coalesce(any_value(upstream + downstream), 0) > 10 THEN 'medium' ELSE 'low' END AS risk
FROM touched LEFT JOIN counts USING (change) GROUP BY change""")
def change_impact(spark, sf_dir):
    """Changed ranges of files, the symbols in them and what those reach, with a grade for each change."""
    file = F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 5).cast("string"), (1 + F.col("s_nationkey") % 5).cast("string"))
    start = F.col("s_suppkey") * 3
    ranges = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("change"), file.alias("file"), start.alias("start"), (start + 40 * (F.col("s_suppkey") % 4)).alias("stop"))
    return G.impact_of_changes(_nodes(spark, sf_dir), _edges(spark, sf_dir, False), ranges, 2)


@query("one_hop_impact", f"WITH {_EDGES} SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS callers, '' AS callees FROM edges WHERE type = 'CALLS' AND target = (SELECT min(target) FROM edges WHERE type = 'CALLS')")
def one_hop_impact(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    symbol = edges.filter("type = 'CALLS'").agg(F.min("target")).first()[0]
    return G.one_hop(edges, symbol).select(F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query("callers_of", f"WITH {_EDGES} SELECT DISTINCT source AS id, 'order_' || substr(source, 3) AS name FROM edges JOIN part ON target = 'p:' || p_partkey WHERE type = 'CALLS' AND p_name = (SELECT max(p_name) FROM part JOIN edges ON target = 'p:' || p_partkey)")
def callers_of(spark, sf_dir):
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    called = edges.filter("type = 'CALLS'").select(F.col("target").alias("id")).distinct()
    name = nodes.join(called, "id", "left_semi").agg(F.max("name")).first()[0]
    hit = edges.filter("type = 'CALLS'").join(nodes.filter(F.col("name") == name).select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return hit.join(nodes, "id").select("id", "name")


@query("symbols_in_file", "SELECT 'p:' || p_partkey AS id, p_name AS name FROM part WHERE p_brand = 'Brand#12'")
def symbols_in_file(spark, sf_dir):
    return G.ask(_nodes(spark, sf_dir), _edges(spark, sf_dir), "symbols_in_file Brand#12")


@query("callees_by_query_language", f"WITH {_EDGES} SELECT DISTINCT target AS id, p_name AS name FROM edges JOIN part ON target = 'p:' || p_partkey WHERE type = 'CALLS' AND source = (SELECT min(source) FROM edges WHERE type = 'CALLS')")
def callees_by_query_language(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    first = edges.filter("type = 'CALLS'").agg(F.min("source")).first()[0]
    return G.ask(_nodes(spark, sf_dir), edges, f"find_callees of order_{first[2:]}")


@query("risk_grade", f"""
WITH {_EDGES} SELECT target AS id, count(*) AS n, CASE WHEN count(*) > 20 THEN 'high' WHEN count(*) > 5 THEN 'medium' WHEN count(*) > 0 THEN 'low' ELSE 'none' END AS of_callers,
CASE WHEN count(*) > 50 THEN 'high' WHEN count(*) > 10 THEN 'medium' WHEN count(*) > 0 THEN 'low' ELSE 'none' END AS of_total FROM edges GROUP BY 1""")
def risk_grade(spark, sf_dir):
    counts = _edges(spark, sf_dir).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return counts.withColumns({"of_callers": G.risk_of_callers(F.col("n")), "of_total": G.risk_of_total(F.col("n"))})


@query("degree_histogram", f"""
WITH {_EDGES}, d AS (SELECT id, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY id)
SELECT CAST(n_out + n_in AS BIGINT) AS degree, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, degree LIMIT 8""")
def degree_histogram(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir)).groupBy((F.col("n_out") + F.col("n_in")).alias("degree")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "degree").limit(8)


@query("graph_without_nodes", f"WITH {_EDGES} SELECT type, count(*) AS n FROM edges WHERE source NOT IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderstatus = 'P') AND target NOT IN (SELECT 'p:' || p_partkey FROM part WHERE p_size > 40) GROUP BY 1")
def graph_without_nodes(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(_id("o:", "o_orderkey").alias("id")).union(table(spark, sf_dir, "part").filter("p_size > 40").select(_id("p:", "p_partkey")))
    return G.without_nodes(_nodes(spark, sf_dir), _edges(spark, sf_dir), gone)[1].groupBy("type").agg(F.count("*").alias("n"))


@query("node_first_wins", "SELECT l_partkey AS id, arg_min(l_suppkey, {'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 's': l_suppkey}) AS l_suppkey FROM lineitem GROUP BY 1")
def node_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return G.first_wins(rows, "id", ["l_shipdate", "l_orderkey", "l_linenumber"]).select("id", "l_suppkey")


@query("edge_last_wins", "SELECT l_partkey AS id, arg_max(l_suppkey, {'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 's': l_suppkey}) AS l_suppkey FROM lineitem GROUP BY 1")
def edge_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return G.last_wins(rows, "id", ["l_shipdate", "l_orderkey", "l_linenumber"]).select("id", "l_suppkey")


@query("latest_version", "SELECT o_orderpriority AS repo, max(o_orderdate) AS analyzed_at, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS version FROM orders GROUP BY 1")
def latest_version(spark, sf_dir):
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_orderdate").alias("analyzed_at"), F.col("o_orderkey").alias("version"))
    return G.latest_version(versions, "repo")


_MODIFIED = "p_partkey % 37 = 0"
_BASE_EDGES = _EDGES.replace("edges AS", "base_edges AS", 1).replace("FROM lineitem", "FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'")
_BASE_STEPS = _STEPS.replace("steps AS", "base_steps AS", 1).replace("FROM edges", "FROM base_edges")


@query("version_diff_risk", f"""
WITH {_EDGES}, {_BASE_EDGES}, {_NODES}, {_STEPS}, {_BASE_STEPS},
changes AS (SELECT 'p:' || p_partkey AS id, CASE WHEN p_partkey % 401 = 7 THEN 'removed' WHEN p_partkey % 389 = 11 THEN 'added' ELSE 'modified' END AS change FROM part WHERE p_partkey % 401 = 7 OR p_partkey % 389 = 11 OR {_MODIFIED}),
{_walk("SELECT id AS seed, id, '' AS direction, true AS expand FROM changes WHERE change <> 'removed'", 2)},
{_walk("SELECT id AS seed, id, '' AS direction, true AS expand FROM changes WHERE change = 'modified'", 2, "b", "base_steps")},
after AS (SELECT DISTINCT id, direction FROM ({_HITS})), before AS (SELECT DISTINCT id, direction FROM (SELECT id, direction FROM b1 UNION ALL SELECT id, direction FROM b2)),
c AS (SELECT count(*) FILTER (WHERE a.direction = 'up') AS upstream, count(*) FILTER (WHERE a.direction = 'down') AS downstream, count(*) FILTER (WHERE a.direction = 'up' AND b.id IS NULL) AS new_upstream,
  count(*) FILTER (WHERE a.direction = 'down' AND b.id IS NULL) AS new_downstream, count(DISTINCT a.id) FILTER (WHERE type = 'route') AS routes FROM after a LEFT JOIN before b ON a.id = b.id AND a.direction = b.direction LEFT JOIN nodes n ON n.id = a.id),
k AS (SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'modified') AS modified FROM changes)
SELECT *, CASE WHEN removed > 0 OR routes > 5 OR upstream + downstream > 50 THEN 'high' WHEN added > 5 OR routes > 0 OR upstream + downstream > 10 THEN 'medium' ELSE 'low' END AS risk FROM k, c""")
def version_diff_risk(spark, sf_dir):
    """Two versions of the graph: parts that only one has, parts with other ends, and fewer calls in the older one."""
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir, False)
    key = F.when(F.col("id").startswith("p:"), F.substring("id", 3, 20).cast("long"))
    is_ = lambda n, r: F.coalesce(key % n == r, F.lit(False))
    base = nodes.filter(~is_(389, 11) | is_(401, 7)).withColumn("stop", F.when(is_(37, 0), F.col("stop") + 5).otherwise(F.col("stop")))
    old = table(spark, sf_dir, "lineitem").filter("l_shipdate < timestamp_ntz '1999-01-01'").select(_id("o:", "l_orderkey").alias("source"), _id("p:", "l_partkey").alias("target"), F.lit("CALLS").alias("type")).distinct()
    return G.compare_versions(base, old.union(edges.filter("type = 'EXTENDS'")), nodes.filter(~is_(401, 7)), edges, 2)


@query("staleness_grade", "SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 'other branch' WHEN s_suppkey % 16 = 0 THEN 'fresh' WHEN s_suppkey % 16 <= 2 THEN 'slight' WHEN s_suppkey % 16 <= 10 THEN 'medium' ELSE 'severe' END AS grade FROM supplier")
def staleness_grade(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", G.staleness(F.col("s_suppkey") % 16, F.col("s_nationkey") % 5 != 0).alias("grade"))


_CALLS = "calls AS (SELECT DISTINCT o_custkey AS source, o_custkey * 2 + o_orderkey % 2 AS target FROM orders)"


def _calls(spark, sf_dir):
    """Each order makes its customer call one of two others, so customers form branching chains."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("source"), (F.col("o_custkey") * 2 + F.col("o_orderkey") % 2).alias("target"), F.lit("CALLS").alias("type")).distinct()


@query("communities")
def communities(spark, sf_dir):
    """Merges of communities in rounds, which SQL can't say; tested by modularity against a greedy search."""
    return G.communities(_calls(spark, sf_dir))


_NATIONS = "labels AS (SELECT c_custkey AS id, c_nationkey AS community FROM customer)"


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))


_MERGED = f"""WITH RECURSIVE {_CALLS}, w AS MATERIALIZED (SELECT a, b, count(*)::DOUBLE AS w FROM (SELECT source AS a, target AS b FROM calls WHERE source <> target UNION ALL SELECT target, source FROM calls WHERE source <> target) GROUP BY ALL),
m AS MATERIALIZED (SELECT sum(w) AS m FROM w), d AS MATERIALIZED (SELECT a AS id, sum(w) AS k FROM w GROUP BY 1),
rounds(n, id, c) AS (SELECT 0, id, id FROM d UNION ALL (WITH cur AS (SELECT * FROM rounds), s AS (SELECT c, sum(k) AS k FROM cur JOIN d USING (id) GROUP BY 1),
  e AS (SELECT x.c AS a, y.c AS b, sum(w.w) AS w FROM w JOIN cur x ON x.id = w.a JOIN cur y ON y.id = w.b WHERE x.c <> y.c GROUP BY 1, 2),
  g AS (SELECT e.a, e.b, e.w - p.k * q.k / m AS gain FROM e JOIN s p ON p.c = e.a JOIN s q ON q.c = e.b, m WHERE e.w - p.k * q.k / m > 1e-9), t AS (SELECT a, arg_min(b, {{'g': -gain, 'b': b}}) AS b FROM g GROUP BY a),
  pair AS (SELECT x.a, x.b FROM t x JOIN t y ON x.b = y.a AND y.b = x.a WHERE x.a > x.b)
  SELECT n + 1, id, coalesce(pair.b, c) FROM cur LEFT JOIN pair ON pair.a = c WHERE EXISTS (SELECT 1 FROM pair))),
merged AS MATERIALIZED (SELECT id, c FROM rounds WHERE n = (SELECT max(n) FROM rounds)), single AS (SELECT c FROM merged GROUP BY 1 HAVING count(*) = 1),
labels AS MATERIALIZED (SELECT id, CASE WHEN (SELECT count(*) FROM single) > 1 AND c IN (SELECT c FROM single) THEN 'misc' ELSE c::VARCHAR END AS community FROM merged)"""


@query("community_cohesion", f"""
{_MERGED}, pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM calls WHERE source <> target),
i AS (SELECT x.community, count(*) AS internal FROM pairs JOIN labels x ON x.id = a JOIN labels y ON y.id = b WHERE x.community = y.community GROUP BY 1)
SELECT community, count(*) AS nodes, coalesce(any_value(internal), 0) AS internal, round(coalesce(any_value(internal), 0) / count(*), 3) AS cohesion FROM labels LEFT JOIN i USING (community) GROUP BY community""")
def community_cohesion(spark, sf_dir):
    """Of communities found in all calls."""
    calls = _calls(spark, sf_dir)
    return G.cohesion(calls, G.merged(calls))


@query("modularity", f"""
WITH {_CALLS}, {_NATIONS}, both_ AS (SELECT source AS a, target AS b FROM calls WHERE source <> target UNION ALL SELECT target, source FROM calls WHERE source <> target),
own AS (SELECT n.id, coalesce(l.community, n.id % 25) AS c FROM (SELECT DISTINCT a AS id FROM both_) n LEFT JOIN labels l USING (id)), m AS (SELECT count(*)::DOUBLE AS m FROM both_),
ends AS (SELECT x.c, y.c AS d FROM both_ JOIN own x ON x.id = a JOIN own y ON y.id = b), each AS (SELECT c, count(*)::DOUBLE AS degree, count(*) FILTER (c = d)::DOUBLE AS inside FROM ends GROUP BY c)
SELECT round(sum(inside / m - pow(degree / m, 2)), 9) AS modularity FROM each, m""")
def modularity(spark, sf_dir):
    """Of nations as communities; who is called but no customer falls into one by its number."""
    edges = _calls(spark, sf_dir)
    nodes = edges.filter("source <> target").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    labels = nodes.join(_nations(spark, sf_dir), "id", "left").select("id", F.coalesce("community", F.col("id") % 25).alias("community"))
    return spark.range(1).select(F.round(F.lit(G.modularity(edges, labels)), 9).alias("modularity"))


@query("community_names", f"""
{_MERGED}, f AS (SELECT community, CASE WHEN id % 5 = 0 THEN '' ELSE 'm' || (id % 4) END AS name, count(*) AS n FROM labels GROUP BY ALL)
SELECT community, arg_min(name, {{'o': -n, 'n': name}}) AS name, sum(n)::BIGINT AS nodes FROM f GROUP BY 1""")
def community_names(spark, sf_dir):
    """Of communities found in all calls."""
    labels = G.merged(_calls(spark, sf_dir))
    file = F.when(F.col("id") % 5 == 0, "main.py").otherwise(F.concat(F.lit("src/m"), (F.col("id") % 4).cast("string"), F.lit("/x.py")))
    return G.community_names(labels, labels.select("id", file.alias("file")))


_PROCESSES = f"""WITH RECURSIVE {_CALLS}, walk(entry, id, depth) AS (SELECT DISTINCT source, source, 0 FROM calls UNION SELECT w.entry, c.target, w.depth + 1 FROM walk w JOIN calls c ON c.source = w.id WHERE w.depth < 20),
seen AS MATERIALIZED (SELECT entry, id, min(depth) AS depth FROM walk GROUP BY ALL),
big AS MATERIALIZED (SELECT entry, list(id) AS ids, row_number() OVER (ORDER BY entry) AS n FROM seen GROUP BY 1 HAVING count(*) >= 3),
greedy(n, held, kept) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL
  SELECT b.n, CASE WHEN list_contains(held, b.entry) THEN held ELSE list_concat(held, b.ids) END, CASE WHEN NOT list_contains(held, b.entry) THEN b.entry END FROM greedy g JOIN big b ON b.n = g.n + 1)"""


@query("process_steps", f"""{_PROCESSES}
SELECT entry, id, row_number() OVER (PARTITION BY entry ORDER BY depth, id) AS step FROM seen WHERE entry IN (SELECT kept FROM greedy)""")
def process_steps(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return G.processes(calls, calls.select(F.col("source").alias("id")).distinct())


@query("process_trace", f"""{_PROCESSES}, starts AS MATERIALIZED (SELECT kept FROM greedy WHERE kept IS NOT NULL),
paths(entry, id, path) AS (SELECT kept, kept, [kept] FROM starts UNION ALL SELECT p.entry, c.target, list_append(p.path, c.target) FROM paths p JOIN calls c ON c.source = p.id AND c.target <> p.id WHERE len(p.path) <= 20),
first AS (SELECT entry, id, min(path) AS path FROM paths GROUP BY ALL)
SELECT entry AS process, row_number() OVER (PARTITION BY entry ORDER BY path) AS position, id, len(path) - 1 AS depth FROM first""")
def process_trace(spark, sf_dir):
    """All processes in depth-first order from their entries."""
    calls = _calls(spark, sf_dir)
    steps = settled(G.reached(calls, calls.select(F.col("source").alias("id")).distinct()).select(F.col("entry").alias("process"), "id"))
    entries = steps.select("process", F.col("process").alias("entry")).distinct()
    return G.traces(steps, calls, entries)


@query("method_overrides", """
WITH RECURSIVE up AS (SELECT s_suppkey AS child, s_suppkey - CASE WHEN s_suppkey % 50 = 1 THEN s_suppkey ELSE 1 END AS parent FROM supplier WHERE s_suppkey % 50 <> 1), methods AS (SELECT DISTINCT l_suppkey AS cls, l_returnflag || l_linestatus || l_linenumber AS method FROM lineitem),
walk(child, parent, depth) AS (SELECT child, parent, 1 FROM up UNION SELECT w.child, u.parent, w.depth + 1 FROM walk w JOIN up u ON u.child = w.parent)
SELECT m.cls, m.method, arg_min(w.parent, {'d': depth, 'p': w.parent}) AS overridden FROM methods m JOIN walk w ON w.child = m.cls JOIN methods n ON n.cls = w.parent AND n.method = m.method GROUP BY 1, 2""")
def method_overrides(spark, sf_dir):
    up = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("child"), (F.col("s_suppkey") - 1).alias("parent")).filter("child % 50 <> 1")
    methods = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cls"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("method")).distinct()
    return G.overrides(up, methods)


@query("return_type_lint", """
WITH r AS (SELECT p_partkey AS id, CASE p_size % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Any' WHEN 2 THEN 'Response' WHEN 3 THEN 'None' WHEN 4 THEN 'str' WHEN 5 THEN '' ELSE 'Order' END AS returns FROM part)
SELECT id, CASE WHEN returns IS NULL OR returns = '' THEN 'missing' WHEN returns = 'Any' THEN 'too broad' WHEN returns = 'Response' THEN 'bare response' WHEN returns = 'None' THEN 'none' WHEN returns = 'str' THEN 'primitive' ELSE '' END AS issues FROM r""")
def return_type_lint(spark, sf_dir):
    size = F.col("p_size") % 9
    returns = F.when(size == 0, None).when(size == 1, "Any").when(size == 2, "Response").when(size == 3, "None").when(size == 4, "str").when(size == 5, "").otherwise("Order")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), G.lint_returns(F.col("p_name"), returns).alias("issues"))


@query("rename_preview", """
WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT path, n AS line, unnest(range(1, length(line) + 1)) AS col, line AS t FROM l WHERE contains(line, 'idiot'))
SELECT path, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS "column" FROM c WHERE substr(t, col, 5) = 'idiot' AND NOT regexp_matches(coalesce(nullif(substr(t, col - 1, 1), ''), ' '), '[A-Za-z0-9_]') AND NOT regexp_matches(coalesce(nullif(substr(t, col + 5, 1), ''), ' '), '[A-Za-z0-9_]')""")
def rename_preview(spark, sf_dir):
    return G.rename_preview(table(spark, sf_dir, "documents"), "doc_id", "text", "idiot")
