"""Filtered, searched and paged lists: orders stand in for test cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import predicates as P
from tessera.plans.registry import query
from tessera.sources.tables import table

_FILTER = "o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'"


def _filtered(spark, sf_dir):
    rows = P.in_where_given(table(spark, sf_dir, "orders"), o_orderstatus=["F", "O"], o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=[])
    return P.in_range(rows, "o_orderdate", F.expr("timestamp_ntz '1996-01-01'"), F.expr("timestamp_ntz '1998-12-31'"))


@query("multi_filter_list", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders WHERE {_FILTER} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def multi_filter_list(spark, sf_dir):
    rows = _filtered(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return P.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 2, 50)


@query("multi_filter_count", f"SELECT count(DISTINCT o_orderkey) AS total FROM orders WHERE {_FILTER}")
def multi_filter_count(spark, sf_dir):
    return _filtered(spark, sf_dir).agg(F.count_distinct("o_orderkey").alias("total"))


@query("multi_filter_page_info", f"SELECT n AS total, CAST(ceil(n / 50) AS BIGINT) AS pages, 2 AS page, greatest(0, least(50, n - 50)) AS rows, 2 < ceil(n / 50) AS has_next FROM (SELECT count(*) AS n FROM orders WHERE {_FILTER})")
def multi_filter_page_info(spark, sf_dir):
    info = P.page_info(_filtered(spark, sf_dir).count(), 2, 50)
    return spark.createDataFrame([(info["total"], info["pages"], 2, info["rows"], info["next"])], "total long, pages long, page int, rows long, has_next boolean")


@query("equality_chain", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
def equality_chain(spark, sf_dir):
    return P.equal_where_given(table(spark, sf_dir, "orders"), o_orderstatus="P", o_custkey=None, o_orderpriority="5-LOW").select("o_orderkey")


@query("key_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
def key_lookup(spark, sf_dir):
    return P.equal_where_given(table(spark, sf_dir, "orders"), o_orderkey=77)


@query("identifier_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey::VARCHAR = '42' OR c_name = '42' ORDER BY (c_custkey::VARCHAR <> '42'), c_custkey LIMIT 1")
def identifier_lookup(spark, sf_dir):
    return P.by_identifier(table(spark, sf_dir, "customer"), "42", "c_custkey", "c_name").select("c_custkey", "c_name", "c_mktsegment")


@query("ilike_search", "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%d#_2%' OR p_brand ILIKE '%d#_2%' OR p_type ILIKE '%d#_2%'")
def ilike_search(spark, sf_dir):
    return P.text_search(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_name", "p_brand", "p_type"], "D#_2")


@query("prefix_filter", "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def prefix_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_brand")


@query("json_key_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '7', '42')")
def json_key_filter(spark, sf_dir):
    return P.json_equals(table(spark, sf_dir, "events"), "props", {"k": ["1", "7", "42"], "other": []}).select("event_id")


@query("json_array_contains", """
SELECT o_custkey FROM (SELECT o_custkey, list(o_orderpriority) AS p FROM orders GROUP BY o_custkey) WHERE list_has_any(p, ['1-URGENT', '3-MEDIUM'])""")
def json_array_contains(spark, sf_dir):
    """Customers whose JSON array of issues holds one of the types."""
    issues = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type")))).alias("issues"))
    return P.json_array_has(issues, "issues", "type", ["1-URGENT", "3-MEDIUM"], "array<struct<id:string,type:string>>").select("o_custkey")


@query("regex_identifier", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '^Customer#0*\\d*7$')")
def regex_identifier(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(F.col("c_name").rlike(r"^Customer#0*\d*7$")).select("c_custkey", "c_name")


@query("date_range_page", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 25 OFFSET 25")
def date_range_page(spark, sf_dir):
    rows = P.in_range(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.expr("timestamp_ntz '2024-01-05'"), F.expr("timestamp_ntz '2024-01-20'"))
    return P.page(rows, [F.col("ts"), F.col("event_id")], 2, 25)


@query("null_filter", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' WHERE o_orderkey IS NULL")
def null_filter(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.filter(F.col("o_orderkey").isNull()).select("c_custkey")


@query("exists_test", "SELECT r_name, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_name LIKE '%A%') AS found FROM region")
def exists_test(spark, sf_dir):
    found = table(spark, sf_dir, "nation").filter(F.col("n_name").contains("A")).select(F.col("n_regionkey").alias("r_regionkey")).distinct().withColumn("found", F.lit(True))
    return table(spark, sf_dir, "region").join(found, "r_regionkey", "left").select("r_name", F.coalesce("found", F.lit(False)).alias("found"))


@query("name_taken_by_another", "SELECT s_suppkey, s_name FROM supplier WHERE s_name = (SELECT min(s_name) FROM supplier) AND s_suppkey <> 3")
def name_taken_by_another(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    name = suppliers.agg(F.min("s_name")).first()[0]
    return suppliers.filter((F.col("s_name") == name) & (F.col("s_suppkey") != 3)).select("s_suppkey", "s_name")


@query("mode_dependent_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (3, 5, 8, 1000)")
def mode_dependent_filter(spark, sf_dir):
    """Given ids override every other filter."""
    ids, status = [3, 5, 8, 1000], "F"
    rows = table(spark, sf_dir, "orders")
    return (P.in_where_given(rows, o_orderkey=ids) if ids else P.equal_where_given(rows, o_orderstatus=status)).select("o_orderkey", "o_orderstatus")


@query("priority_order_page", """
SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE 5 END, o_orderkey DESC LIMIT 30""")
def priority_order_page(spark, sf_dir):
    """Sorted by the natural order of an enumeration, not its text."""
    place = P.ranked("o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])
    return P.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), [place, F.desc("o_orderkey")], 1, 30)


@query("null_safe_update", """
SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) END, s_name) AS s_name FROM supplier""")
def null_safe_update(spark, sf_dir):
    """An update in which a null leaves the old value."""
    suppliers = table(spark, sf_dir, "supplier")
    new = F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name"))
    return suppliers.select("s_suppkey", F.coalesce(new, F.col("s_name")).alias("s_name"))
