"""Group-bys, windows, serials, trees and data modification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as A, changes as C, trees as T
from tessera.operators.predicates import ranked
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("type_counts", "SELECT p_type AS type, count(*) AS n FROM part GROUP BY 1")
def type_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"))


@query("group_order_by_max", "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1 ORDER BY last DESC, user_id")
def group_order_by_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id")


@query("child_sums", "SELECT n_nationkey, n_name, count(c_custkey) AS children, CAST(coalesce(sum(c_custkey % 7), 0) AS BIGINT) AS cases FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY ALL")
def child_sums(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    return A.child_sums(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", customers, "c_nationkey", cases=F.col("c_custkey") % 7)


@query("parent_counts", """
SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def parent_counts(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    one = A.child_sums(nations, "n_nationkey", table(spark, sf_dir, "customer"), "c_nationkey").withColumnRenamed("children", "customers")
    return A.child_sums(one, "n_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey").withColumnRenamed("children", "suppliers")


@query("next_serial", "SELECT greatest(coalesce(max(CAST(regexp_extract(c_name, '^Customer#(\\d+)$', 1) AS BIGINT)), 1000), 1000) + 1 AS next_serial FROM customer")
def next_serial(spark, sf_dir):
    return A.next_serial(table(spark, sf_dir, "customer"), "c_name", "Customer#")


@query("day_serial", "SELECT 'RUN-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(count(*) + 1 AS VARCHAR), 3, '0') AS next_id FROM orders GROUP BY strftime(o_orderdate, '%Y%m%d')")
def day_serial(spark, sf_dir):
    """The next number of each day."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    days = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg((F.count("*") + 1).alias("n"))
    return days.select(F.concat(F.lit("RUN-"), "day", F.lit("-"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("next_id"))


@query("histogram_fixed_buckets", """
SELECT count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'refund') AS refund,
  count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN ('error', 'view', 'refund')) AS unknown FROM events""")
def histogram_fixed_buckets(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), "event_type", ["error", "view", "refund"], "unknown")


@query("mode_per_group", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1")
def mode_per_group(spark, sf_dir):
    return A.mode(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("first_seen_dedup", "SELECT arg_min(event_id, {'t': ts, 'i': event_id}) AS event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events GROUP BY ALL")
def first_seen_dedup(spark, sf_dir):
    """The first row of each key in order of arrival."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rows.groupBy("user_id", "event_type", "k").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("f.event_id", "user_id", "event_type", "k")


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    return A.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")])


@query("keep_newest_n", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 10")
def keep_newest_n(spark, sf_dir):
    return C.keep_newest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 10).select("o_custkey", "o_orderkey")


@query("dense_renumber", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders WHERE o_orderstatus <> 'P'")
def dense_renumber(spark, sf_dir):
    return A.renumbered(table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey"), ["o_custkey"], [F.col("o_orderkey")], "step")


@query("explicit_reorder", "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 + n_nationkey END AS place FROM nation")
def explicit_reorder(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey").isin(3, 1, 2), ranked("n_nationkey", [3, 1, 2])).otherwise(F.col("n_nationkey") + 3).alias("place"))


@query("history_newest_first", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey")
def history_newest_first(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_custkey = 7").select("o_orderkey", "o_orderdate", "o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("result_totals", """
SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS passed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')) AS skipped, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS duration FROM lineitem GROUP BY 1""")
def result_totals(spark, sf_dir):
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(flag == "A").alias("passed"), F.count_if(flag == "R").alias("failed"), F.count_if(~flag.isin("A", "R")).alias("skipped"), F.sum(F.col("l_quantity").cast("long")).alias("duration"))


@query("group_to_list", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def group_to_list(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    return lists.select("o_custkey", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("orders"))


_TREE = """tree AS (SELECT 'r:' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer),
walk(ancestor, id, depth) AS (SELECT id, id, 0 FROM tree UNION ALL SELECT w.ancestor, t.id, w.depth + 1 FROM walk w JOIN tree t ON t.parent_id = w.id)"""


def _tree(spark, sf_dir):
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = table(spark, sf_dir, "region").select(node("r:", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    nations = table(spark, sf_dir, "nation").select(node("n:", "n_nationkey"), node("r:", "n_regionkey"))
    return regions.union(nations).union(table(spark, sf_dir, "customer").select(node("c:", "c_custkey"), node("n:", "c_nationkey")))


@query("tree_closure", f"WITH RECURSIVE {_TREE} SELECT ancestor, id, depth FROM walk")
def tree_closure(spark, sf_dir):
    return T.closure(_tree(spark, sf_dir))


@query("subtree_counts", f"""
WITH RECURSIVE {_TREE}, items AS (SELECT 'c:' || o_custkey AS folder FROM orders)
SELECT t.id, (SELECT count(*) FROM items WHERE folder = t.id) AS direct, coalesce((SELECT count(*) FROM walk w JOIN items ON folder = w.id WHERE w.ancestor = t.id), 0) AS total, (SELECT count(*) FROM tree k WHERE k.parent_id = t.id) AS children FROM tree t""")
def subtree_counts(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("folder"))
    return T.subtree_counts(_tree(spark, sf_dir), items, "folder")


@query("tree_depth_first", f"""
WITH RECURSIVE {_TREE}, items AS (SELECT 'c:' || o_custkey AS folder FROM orders),
paths(id, parent, path, depth) AS (SELECT id, parent_id, [id], 0 FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, t.parent_id, list_append(p.path, t.id), p.depth + 1 FROM paths p JOIN tree t ON t.parent_id = p.id)
SELECT row_number() OVER (ORDER BY path) AS position, p.id, parent, depth, (SELECT count(*) FROM items WHERE folder = p.id) AS direct,
  coalesce((SELECT count(*) FROM walk w JOIN items ON folder = w.id WHERE w.ancestor = p.id), 0) AS total, (SELECT count(*) FROM tree k WHERE k.parent_id = p.id) AS children FROM paths p""")
def tree_depth_first(spark, sf_dir):
    """The folder tree as it is shown: depth first, with counts."""
    items = table(spark, sf_dir, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("folder"))
    return T.depth_first(_tree(spark, sf_dir), items, "folder")


@query("tree_copy", f"WITH RECURSIVE {_TREE} SELECT 'copy-' || t.id AS id, CASE WHEN t.id = 'r:2' THEN 'r:0' ELSE 'copy-' || t.parent_id END AS parent_id FROM walk w JOIN tree t ON t.id = w.id WHERE w.ancestor = 'r:2'")
def tree_copy(spark, sf_dir):
    return T.copy(_tree(spark, sf_dir), "r:2", F.concat(F.lit("copy-"), "id"), "r:0")


@query("tree_copy_with_rows", f"""
WITH RECURSIVE {_TREE}, below AS (SELECT id FROM walk WHERE ancestor = 'r:2'), cases AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE 'c:' || o_custkey IN (SELECT id FROM below))
SELECT 'case' AS kind, 'copy-o:' || o_orderkey AS id, 'copy-c:' || o_custkey AS owner, o_orderpriority AS what FROM cases
UNION ALL SELECT 'step', 'copy-l:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'copy-o:' || l_orderkey, l_returnflag FROM lineitem JOIN cases ON l_orderkey = o_orderkey""")
def tree_copy_with_rows(spark, sf_dir):
    """A folder's subtree copied with its cases (orders) and their steps (lines)."""
    new = F.concat(F.lit("copy-"), "id")
    copied = T.subtree(_tree(spark, sf_dir), "r:2").select(F.col("id").alias("old"), new.alias("new"))
    key = lambda p, *c: F.concat(F.lit(p), F.concat_ws("-", *[F.col(x).cast("string") for x in c]))
    cases = table(spark, sf_dir, "orders").select(key("o:", "o_orderkey").alias("id"), key("c:", "o_custkey").alias("owner"), F.col("o_orderpriority").alias("what"))
    steps = table(spark, sf_dir, "lineitem").select(key("l:", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), key("o:", "l_orderkey").alias("owner"), F.col("l_returnflag").alias("what"))
    new_cases = T.copy_rows(cases, copied, "owner", new)
    new_steps = T.copy_rows(steps, new_cases.select(F.expr("substr(id, 6)").alias("old"), F.col("id").alias("new")), "owner", new)
    return new_cases.select(F.lit("case").alias("kind"), "*").union(new_steps.select(F.lit("step"), "*"))


@query("tree_move", f"WITH RECURSIVE {_TREE} SELECT id, CASE WHEN id = 'n:5' THEN 'r:3' ELSE parent_id END AS parent_id FROM tree")
def tree_move(spark, sf_dir):
    return T.move(_tree(spark, sf_dir), "n:5", "r:3")


@query("folders_from_paths", """
WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS parts FROM p),
every AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS id FROM s, range(1, 100) t(i) WHERE i <= len(parts))
SELECT id, CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') ELSE '' END AS parent_id FROM every UNION ALL SELECT '', NULL""")
def folders_from_paths(spark, sf_dir):
    return T.folders_of(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")), "path")


@query("get_or_create", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT min(s_suppkey) + 1000, s_name FROM supplier WHERE s_name NOT IN (SELECT n_name FROM nation) GROUP BY s_name")
def get_or_create(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("n_nationkey"), F.col("s_name").alias("n_name"))
    return C.get_or_create(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), wanted, ["n_name"])


@query("delete_by_predicate", "SELECT s_suppkey FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)")
def delete_by_predicate(spark, sf_dir):
    return C.delete(table(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0).select("s_suppkey")


@query("update_from_assignments", """
SELECT o_orderkey, CASE WHEN c_acctbal > 5000 THEN 'A' ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def update_from_assignments(spark, sf_dir):
    new = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.lit("A").alias("o_orderstatus"))
    return C.update(table(spark, sf_dir, "orders"), new, ["o_custkey"]).select("o_orderkey", "o_orderstatus")


@query("clear_default", "SELECT s_suppkey, CASE WHEN s_nationkey = 4 THEN s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 4) ELSE s_acctbal > 0 END AS is_default FROM supplier")
def clear_default(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("is_default", F.col("s_acctbal") > 0)
    chosen = rows.filter("s_nationkey = 4").agg(F.min("s_suppkey")).first()[0]
    return C.clear_default(rows, "s_nationkey", 4, "s_suppkey", chosen, "is_default").select("s_suppkey", "is_default")


@query("cascade_delete", """
SELECT 'nation' AS t, count(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1))
UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey <> 1""")
def cascade_delete(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders")}
    links = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")]
    left = C.cascade(tables, tables["region"].filter("r_regionkey = 1"), links)
    return C.union_all([df.agg(F.count("*").alias("n")).withColumn("t", F.lit(t)) for t, df in left.items()], ["t", "n"])


@query("bulk_edit", """
SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(p, lambda x: x <> '5-LOW'), ['checked']))), ',') AS tags FROM (SELECT o_custkey, list(o_orderpriority) AS p FROM orders GROUP BY 1)""")
def bulk_edit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("tags"))
    edited = C.edit_list(C.edit_list(F.col("tags"), "remove", ["5-LOW"]), "add", ["checked"])
    return rows.select("o_custkey", F.array_join(edited, ",").alias("tags"))


@query("append_results", """
WITH last AS (SELECT l_partkey AS id, arg_max(l_returnflag, {'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 'f': l_returnflag}) AS s, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT p_partkey, coalesce(s, 'none') AS status, coalesce(n, 0) AS n_results FROM part LEFT JOIN last ON p_partkey = id WHERE p_size > 5""")
def append_results(spark, sf_dir):
    cases = table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey", F.lit("none").alias("status"))
    results = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("status"), "l_shipdate", "l_orderkey", "l_linenumber")
    return C.apply_results(cases, results, "p_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "status"], "status")[0]


@query("results_of_no_case", "SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1")
def results_of_no_case(spark, sf_dir):
    cases = table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey", F.lit("none").alias("status"))
    results = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("status"))
    return C.apply_results(cases, results, "p_partkey", ["status"], "status")[1].groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("replace_version", "SELECT o_orderkey, o_custkey, 'old' AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def replace_version(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    old = rows.filter("o_orderdate < timestamp_ntz '1997-01-01'").select("o_orderkey", "o_custkey", F.lit("old").alias("v"))
    new = rows.filter("o_orderdate >= timestamp_ntz '2001-01-01'").select("o_orderkey", "o_custkey", F.lit("new").alias("v"))
    return C.replace_versions(old, new, ["o_custkey"])
