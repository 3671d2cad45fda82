import json
import re

import duckdb
from pyspark.sql import functions as F

from tessera.llm import tool_calls as tools


def test_query_equals_oracle(spark):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from read_parquet('{d}/conversations.parquet')")
    frame = tools.query(spark, d)
    names = db.execute(tools.SQL).fetchall()
    columns = [c[0] for c in db.description]
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(names)


def test_errors(spark):
    cases = {
        ("ask", '{"text":"x","turn":1}'): "",
        ("ask", '{"text":1,"more":null}'): "missing:turn,type:text,unexpected:more",
        ("ask", "[1]"): "object",
        ("ask", "not json"): "object",
        ("ask", ""): "object",
        ("none", "{}"): "tool",
        ("compute", '{"expression":"1+1","precision":2,"exact":true}'): "",
        ("compute", '{"expression":"1+1","precision":2.5,"exact":"no"}'): "type:exact",
        ("store", '{"key":"k","value":{"a":[1]},"tags":[1,"b"]}'): "",
        ("store", '{"key":null,"value":[],"tags":{}}'): "type:key,type:tags,type:value",
        ("search", '{"query":"q","limit":1.5}'): "type:limit",
        ("search", '{"query":"q","limit":15e-1}'): "type:limit",
        ("search", '{"query":"q","limit":1.50e1}'): "",
        ("search", '{"query":"q","limit":1e400}'): "",
        ("search", '{"query":"q","query":"r"}'): "object",
        ("search", '{"query":"q","more":{"a":1,"a":2}}'): "object",
        ("search", '{"query":"\uffffn5"}'): "object",
        ("search", '{"query":"q","limit":01}'): "object",
        ("search", '{"query":"q","deep":' + "[" * 1500 + "]" * 1500 + "}"): "object",
        ("search", '{"query":"q"} {}'): "object",
    }
    rows = spark.createDataFrame(list(cases), "name string, arguments string").withColumn("e", tools.errors(F.col("name"), F.col("arguments"))).collect()
    assert {(r.name, r.arguments): r.e for r in rows} == cases


def test_levels_of_a_graph_with_a_cycle(spark):
    needs = {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c", "a", "gone", None], "x": ["y"], "y": ["x"], "z": ["x", "a"], "s": ["s"], "i": None}
    calls = spark.createDataFrame([("k", c, "ask", "{}", n) for c, n in needs.items()] + [("other", "c", "ask", "{}", ["a"])], "conv_id string, call_id string, name string, arguments string, depends_on array<string>")
    rows = tools.link(calls, spark.createDataFrame([], "conv_id string, call_id string, content string")).collect()
    assert {(r.conv_id, r.call_id): (r.level, r.n_missing) for r in rows} == {("k", "a"): (0, 0), ("k", "b"): (1, 0), ("k", "c"): (2, 0), ("k", "d"): (3, 1), ("k", "x"): (None, 0), ("k", "y"): (None, 0), ("k", "z"): (None, 0), ("k", "s"): (None, 0), ("k", "i"): (0, 0), ("other", "c"): (0, 1)}


def test_edge_rows(spark):
    long = "é" * 200_000
    data = [(1, "a", "ask", '{"turn": 1, "text": "x", "b": {"z":1, "a":[2, 1.50]}}', []), (1, "a", "ask", "{ }", []), (None, None, None, None, None), (1, "c", "ask", json.dumps({"text": long, "turn": 2}), ["a"]), (2, "a", "ask", "[]", ["a", "a"])]
    calls = spark.createDataFrame(data, "conv_id long, call_id string, name string, arguments string, depends_on array<string>").withColumn("level", F.lit("x")).withColumn("result", F.lit("x"))
    results = spark.createDataFrame([(1, "c", "two"), (1, "c", "one"), (1, "a", None), (None, None, "r"), (9, "c", "lost")], "conv_id long, call_id string, content string").withColumn("name", F.lit("x"))
    by = {(r.conv_id, r.call_id): r for r in tools.link(calls, results).collect()}
    assert len(by) == 5 and by["9", "c"].errors == "call" and by["9", "c"].n_calls == 0 and by["9", "c"].message == '{"call_id":"c","result":"lost"}'
    assert by["1", "a"].n_calls == 2 and by["1", "a"].n_results == 0 and by["1", "a"].message == '{"arguments":{},"call_id":"a","level":0,"name":"ask"}'
    assert by["1", "c"].n_results == 2 and json.loads(by["1", "c"].message)["result"] == "one" and json.loads(by["1", "c"].message)["arguments"]["text"] == long
    assert by["", ""].errors == "object" and by["", ""].message == '{"call_id":"","level":0,"name":"","result":"r"}'
    assert by["2", "a"].level is None and by["2", "a"].errors == "object"
    assert tools.link(calls.limit(0), results.limit(0)).count() == 0
    assert spark.createDataFrame([(data[0][3],)], "j string").select(tools.canonical(F.col("j"))).first()[0] == '{"b":{"a":[2,1.5],"z":1},"text":"x","turn":1}'
    asked, answered = tools.calls_of(spark.createDataFrame([(None, None, "user", None), (1, 4, "user", "q"), (1, 5, "assistant", "a"), (1, 2, "user", "p"), (1, 2, None, "z")], "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.call_id): (r.level, r.n_results, r.errors) for r in tools.link(asked, answered).collect()}
    assert got == {("", "null-null"): (0, 0, "missing:text,missing:turn"), ("1", "1-4"): (1, 1, ""), ("1", "1-2"): (0, 0, "")}


def test_the_query_meets_every_kind_of_fault(spark):
    rows = tools.query(spark, "/root/testdata/sf0.01").collect()
    seen = {e for r in rows for e in r.errors.split(",")}
    assert seen >= {"", "object", "tool", "missing:query", "type:limit", "unexpected:page", "type:exact", "type:value"}
    assert {r.level for r in rows} >= {None, 0, 1, 2} and any(r.n_missing for r in rows) and {r.name for r in rows} >= {"ask", "search", "compute", "store", "fly"}


def test_numbers_have_one_form(spark):
    same = {
        "1": ["1", "1.0", "1e0", "10e-1", "0.1e1"], "100": ["1e2", "100", "1E+2", "100.00"], "0": ["0", "-0", "0.0", "-0.0e5"], "-2.5": ["-2.5", "-25e-1", "-2.50"],
        "123456789012345678901": ["123456789012345678901", "1.23456789012345678901e20"], "1.23456789012345678901234567890123456789012e+41": ["123456789012345678901234567890123456789012"],
        "0.000001": ["1e-6", "0.000001"], "1e-7": ["0.0000001", "1e-7", "10E-8"], "1e+21": ["1000000000000000000000"],
    }
    rows = [(want, f'{{ "n" : {n}, "s":"1.0 {n}" }}', n) for want, forms in same.items() for n in forms]
    got = spark.createDataFrame(rows, "want string, j string, n string").select("want", "n", tools.canonical(F.col("j")).alias("c")).collect()
    for r in got:
        assert r.c == f'{{"n":{r.want},"s":"1.0 {r.n}"}}'


def test_no_python_in_the_plan(spark):
    plan = tools.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
