import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes as C, graph as G, joins as J, predicates as P, scenario as S, search, trees as T


def test_empty_parameters_do_not_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "id long, name string")
    assert P.in_where_given(df, id=[], name=None).count() == 3
    assert P.text_search(df, ["name"], "").count() == 3
    assert P.equal_where_given(df, id=2, name=None).count() == 1
    assert P.page_info(0, 1, 20) == {"total": 0, "pages": 0, "page": 1, "rows": 0, "next": False, "previous": False}
    assert P.page_info(45, 3, 20)["rows"] == 5


def test_tree_cycles_are_found(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        T.closure(loop)
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    with pytest.raises(ValueError, match="below"):
        T.move(tree, "a", "c")
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "id long, parent_id long")
    assert T.closure(chain).count() == 210


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice("xy"), i, a := rng.randrange(300), a + rng.randrange(150)) for i in range(n)]  # noqa: E731, F821
    a, b = make(40), [*make(40), ("x", 99, None, 5)]
    schema = "file string, id long, start long, stop long"
    got = J.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "file").select("range_id", "span_id").collect()
    want = [(i, j) for f, i, s, e in a for g, j, t, u in b if f == g and t is not None and s <= u and e >= t]
    assert sorted(map(tuple, got)) == sorted(want)


def test_query_language(spark):
    nodes = spark.createDataFrame([("m::Foo", "class", "Foo", "m.py"), ("m::Foo.bar", "method", "bar", "m.py"), ("x", "file", "x.py", "x.py")], "id string, type string, name string, file string")
    edges = spark.createDataFrame([("x", "m::Foo", "CALLS"), ("m::Foo", "m::Foo.bar", "HAS_METHOD"), ("x", "gone", "IMPORTS")], "source string, target string, type string")
    ids = lambda q: [(r.id, r.name) for r in G.ask(nodes, edges, q).collect()]
    assert ids("find_callers of Foo") == [("x", "x.py")]
    assert ids("find_methods of Foo") == [("m::Foo.bar", "bar")]
    assert ids("imports_of x.py") == [("gone", "gone")]
    with pytest.raises(ValueError, match="unknown"):
        G.ask(nodes, edges, "drop table")


def test_bm25_scores_every_document(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "a dog and a cat"), (3, None), (4, "bird")], "id long, text string")
    scores = {r.id: r.score for r in search.bm25(docs, "id", "text", "Bird dog").collect()}
    assert set(scores) == {1, 2, 3, 4} and scores[4] > scores[2] > scores[1] == scores[3] == 0
    assert search.full_text(docs, "id", "text", "the").count() == 0
    assert search.bm25(docs.limit(0), "id", "text", "x").count() == 0


def test_lists_and_maps(spark):
    df = spark.createDataFrame([(["b", "a"], {"k": "1", "m": "2"}), (None, {})], "l array<string>, m map<string,string>")
    lists = [df.select(C.edit_list(F.col("l"), op, ["a", "c"])).collect()[0][0] for op in ("ignore", "replace", "add", "remove")]
    assert lists == [["a", "b"], ["a", "c"], ["a", "b", "c"], ["b"]]
    maps = [df.select(C.edit_map(F.col("m"), op, {"k": "9"})).first()[0] for op in ("ignore", "replace", "merge", "remove")]
    assert maps == [{"k": "1", "m": "2"}, {"k": "9"}, {"m": "2", "k": "9"}, {"m": "2"}]


def test_reports_of_any_depth(spark):
    leaf = '{"title":"t","tests":[{"projectName":"p","results":[{"status":"passed","duration":1.5},{"status":"failed"}]}]}'
    nested = f'{{"title":"s25","specs":[{leaf}]}}'
    for i in range(24, 0, -1):
        nested = f'{{"title":"s{i}","suites":[{nested}]}}'
    reports = spark.createDataFrame([(1, f'{{"suites":[{nested}]}}'), (2, "broken"), (3, None), (4, "{}")], "id long, j string")
    rows = S.flatten_reports(reports, "id", "j").collect()
    path = " > ".join(f"s{i}" for i in range(1, 26))
    assert sorted((r.id, r.path, r.title, r.project, r.status, r.duration, r.ok) for r in rows) == [(1, path, "t", "p", "failed", 0.0, True), (1, path, "t", "p", "passed", 1.5, True)]
    assert [(r.id, r["name"], r.project, r.status, r.ok, r.duration) for r in S.tests_of_reports(reports, "id", "j").collect()] == [(1, "t", "p", "passed", False, 1.5)]
    assert S.top_tests(reports, "id", "j").count() == 0


def test_templates_are_filled_once(spark):
    values = {"a": "{{b}}", "b": "x", "c.d": "$1\\\\", "n": None}
    cases = {"{{a}} {{b}}": "{{b}} x", "{{c.d}}{{n}}{{gone}}": "$1\\\\{{n}}{{gone}}", "{{{b}}}": "{x}", "{{a b}}": "{{a b}}", "": "", "{": "{"}
    rows = spark.createDataFrame([(t, values) for t in cases], "t string, v map<string,string>").select("t", S.substitute(F.col("t"), F.col("v")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases
    row = spark.createDataFrame([("/a/{x}/{y}/{z}", {"x": "{y}", "y": "1"})], "t string, v map<string,string>").select(S.path_parameters(F.col("t"), F.col("v"))).first()
    assert row[0] == "/a/{y}/1/{z}"


def test_names_with_signs_are_plain_text(spark):
    files = spark.createDataFrame([("f", "a+b = aab\nx.a+b(a+b)\na+bc")], "path string, text string")
    assert sorted((r.line, r.column) for r in G.rename_preview(files, "path", "text", "a+b").collect()) == [(1, 1), (2, 3), (2, 7)]


def test_ancestors_of_any_height_and_cycles(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(15)] + [("x", "y"), ("y", "x"), ("x", "c0")]
    methods = [("c0", "m"), ("c15", "m"), ("x", "m"), ("c3", "k"), ("y", "k")]
    got = G.overrides(spark.createDataFrame(chain, "child string, parent string"), spark.createDataFrame(methods, "cls string, method string")).collect()
    assert {(r.cls, r.method, r.overridden) for r in got} == {("c0", "m", "c15"), ("x", "m", "c0"), ("y", "k", "c3")}
    implements = spark.createDataFrame([("c0", "i"), ("c3", "i")], "child string, interface string")
    declared = spark.createDataFrame([*methods, ("i", "m")], "cls string, method string")
    assert [(r.cls, r.method, r.interface) for r in G.method_implements(implements, declared).collect()] == [("c0", "m", "i")]


def test_versions_and_changes(spark):
    names = "id string, type string, name string, file string, start long, stop long"
    base = spark.createDataFrame([("a", "function", "a", "f", 1, 5), ("b", "function", "b", "f", 6, 9), ("r", "route", "r", "g", 1, 2), ("old", "function", "o", "g", 3, 4)], names)
    new = spark.createDataFrame([("a", "function", "a", "f", 1, 6), ("b", "function", "b", "f", 6, 9), ("r", "route", "r", "g", 1, 2), ("n", "function", "n", "g", 3, 4)], names)
    edge = lambda *e: spark.createDataFrame([(s, t, "CALLS") for s, t in e], "source string, target string, type string")
    row = G.compare_versions(base, edge(("b", "a")), new, edge(("b", "a"), ("r", "b"), ("n", "r")), 3).first()
    # from a: b up, r up at 2, n up at 3; from n: r down, b down, a down
    assert row.asDict() == {"added": 1, "removed": 1, "modified": 1, "upstream": 3, "downstream": 3, "new_upstream": 2, "new_downstream": 3, "routes": 1, "risk": "high"}
    ranges = spark.createDataFrame([(1, "f", 6, 6), (2, "f", 20, 30), (3, "g", 2, 3)], "change long, file string, start long, stop long")
    got = {r.change: (r.symbols, r.upstream, r.downstream, r.routes, r.risk) for r in G.impact_of_changes(new, edge(("b", "a"), ("r", "b")), ranges, 1).collect()}
    assert got == {1: (2, 2, 1, 1, "medium"), 3: (2, 0, 1, 0, "low")}


def test_calls_are_resolved_by_seven_rules(spark):
    symbols = [("class", "f", None, "C"), ("method", "f", "C", "m"), ("func", "f", None, "g"), ("class", "h", None, "K"), ("method", "h", "K", "m"), ("func", "h", None, "imp"), ("func", "z", None, "far"), ("method", "y", "Q", "far")]
    calls = [(1, "f", "C", "self", "m"), (2, "f", "C", "self", "far"), (3, "f", None, "v", "m"), (4, "f", None, None, "imp"), (5, "f", None, None, "g"), (6, "f", None, "C", "m"), (7, "f", None, "K", "m"), (8, "f", None, "mod", "imp"), (9, "f", None, None, "far"), (10, "f", None, None, "none")]
    frames = (spark.createDataFrame(calls, "id long, file string, cls string, scope string, name string"), spark.createDataFrame(symbols, "kind string, file string, owner string, name string"), spark.createDataFrame([("f", "v", "h::K")], "file string, variable string, type string"), spark.createDataFrame([("f", "imp", "h"), ("f", "K", "h"), ("f", "mod", "h")], "file string, alias string, target string"))
    got = {r.id: (r.rule, r.symbol, r.confidence) for r in J.resolve_calls(*frames).collect()}
    assert got == {
        1: (1, "method://f::C.m", "high"), 2: (None, None, None), 3: (2, "method://h::K.m", "high"), 4: (3, "func://h::imp", "medium"), 5: (4, "func://f::g", "high"), 6: (5, "method://f::C.m", "high"),
        7: (6, "method://h::K.m", "medium"), 8: (6, "func://h::imp", "medium"), 9: (7, "func://z::far", "low"), 10: (None, None, None),
    }


def test_comparisons(spark):
    cases = {("10", "gt", "9"): True, ("a", "gt", "b"): False, ("5", "lt", "40"): True, ("abc", "contains", "b"): True, ("1", "eq", "1"): True, ("1", "ne", "1"): False, (None, "eq", "1"): False, ("1", "like", "1"): False}
    rows = spark.createDataFrame(list(cases), "a string, o string, e string").withColumn("r", S.compare(F.col("a"), F.col("o"), F.col("e"))).collect()
    assert {(r.a, r.o, r.e): r.r for r in rows} == cases


def test_cascade_and_first_rule(spark):
    calls = spark.createDataFrame([(1, "a", "f"), (2, "b", "g"), (3, "c", "h")], "id long, file string, name string")
    symbols = spark.createDataFrame([("a", "f", "s1"), ("z", "g", "s2"), ("z", "f", "s0")], "file string, name string, sym string")
    got = J.first_rule(calls, ["id"], [(1, symbols, ["file", "name"], "sym"), (2, symbols, ["name"], "sym")], "hit")
    assert {r.id: (r.rule, r.hit) for r in got.collect()} == {1: (1, "s1"), 2: (2, "s2"), 3: (None, None)}
