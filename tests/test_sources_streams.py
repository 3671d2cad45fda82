import json
import zipfile

from pyspark.sql import functions as F

from tessera.operators import extract as X
from tessera.sources import files
from tessera.streaming import limits


def test_source_tree(spark, tmp_path):
    for path, text in {"a.py": "x = 1", "pkg/b.py": "y = 2", "node_modules/c.js": "", "pkg/d.PNG": "", "logs/e.txt": "", "keep/logs.txt": "z", "pkg/gen_f.py": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "large.py").write_text("#" * (files.MAX_BYTES + 1))
    rows = files.source_files(spark, str(tmp_path), ["# note", "logs/", "gen_*.py"]).collect()
    assert [r.path for r in rows] == ["a.py", "keep/logs.txt", "pkg/b.py"]


def test_zip_and_reports(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1/report.json").write_text('{"suites": []}')
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("widgets/summary.json", '{"n": 1}')
    (tmp_path / "b.zip").write_bytes(b"no zip")
    assert [r.json for r in files.report_files(spark, str(tmp_path)).collect()] == ['{"suites": []}']
    assert sorted((r.path[-5:], r.text) for r in files.zip_members(spark, str(tmp_path)).collect()) == [("a.zip", '{"n": 1}'), ("b.zip", None)]


def test_trailing_json(spark):
    cases = {'log {"a": 1} more {"b": {"c": [1, "}"]}} end': '{"b": {"c": [1, "}"]}}', "none": None, "": None, "{broken": None, 'x {"a": 1} }': '{"a": 1}'}
    assert {k: files.last_json(k) for k in cases} == cases
    rows = files.trailing_json(spark.createDataFrame([(1, 'x {"a": 1}'), (2, None)], "id long, t string"), "id", "t").collect()
    assert {r.id: r.json for r in rows} == {"1": '{"a": 1}', "2": None}


def test_versions_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/graph"
    old = spark.createDataFrame([("r", "c1", 1), ("r", "c2", 2)], "repo string, commit string, n int")
    files.write_version(old, path, ["repo", "commit"])
    for _ in range(2):
        files.write_version(spark.createDataFrame([("r", "c2", 3)], "repo string, commit string, n int"), path, ["repo", "commit"])
    assert sorted((r.commit, r.n) for r in spark.read.parquet(path).collect()) == [("c1", 1), ("c2", 3)]


def test_rule_files(spark, tmp_path):
    rules = [{"id": "a", "category": "c", "priority": 1, "enabled": True, "error_message_patterns": ["x"]}, {"id": "b", "category": "c", "priority": 9, "status_code": [404]}, {"id": "off", "category": "c", "enabled": False}]
    (tmp_path / "r.json").write_text(json.dumps({"rules": rules}))
    assert [r.id for r in files.rules(spark, f"{tmp_path}/r.json").collect()] == ["b", "a"]


def test_streams_equal_batches(spark, tmp_path):
    from tessera.plans.diagnosis import logs

    batch = logs(spark, "/root/testdata/sf0.001")
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = limits.classified(stream).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("found").exceptAll(limits.classified(batch)).count() == 0 and spark.table("found").count() == batch.count()


def test_python_files_that_do_not_parse(spark):
    rows = spark.createDataFrame([("a.py", "def f(:"), ("b.py", None), ("c.py", "import os.path as p\nfrom x import y\nz = 1")], "path string, text string")
    want = [("b.py", "module", "b", "b.py"), ("c.py", "import", "p", "os.path"), ("c.py", "import", "y", "x.y"), ("c.py", "module", "c", "c.py"), ("c.py", "variable", "z", "z")]
    assert sorted((r.path, r.kind, r["name"], r.qualified) for r in X.python_symbols(rows, "path", "text").collect()) == want


def test_script_blocks_and_calls(spark):
    text = "const a = () => 1;\nfunction b(x) {\n  if (x) { return a() }\n  return b(x)\n}\nclass C {\n  m(y) {\n    this.n(b(y))\n  }\n  n(z) { call(() => a()) }\n}\nb(1)"
    rows = spark.createDataFrame([("x.js", text), ("y.js", None), ("z.js", "function (")], "path string, text string")
    symbols = {(r.kind, r["name"], r.start, r.stop) for r in X.script_symbols(rows, "path", "text").collect()}
    assert symbols == {("function", "a", 1, 1), ("function", "b", 2, 5), ("class", "C", 6, 11), ("method", "m", 7, 9), ("method", "n", 10, 10)}
    calls = {(r.caller, r.callee, r.line) for r in X.script_calls(rows, "path", "text").collect()}
    assert calls == {("b", "a", 3), ("b", "b", 4), ("m", "n", 8), ("m", "b", 8), ("n", "a", 10)}
