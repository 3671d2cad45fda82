import pytest
from pyspark.sql import functions as F

from tessera.operators import diagnosis as D

#: Statuses and messages with the category and rule that must come out.
VECTORS = [
    (401, "Token expired", "token_expired", "token_expired_rule_1"),
    (401, "invalid_token", "token_expired", "token_expired_rule_1"),
    (401, "jwt invalid", "token_expired", "token_expired_rule_1"),
    (403, "Forbidden", "permission_denied", "permission_denied_rule_1"),
    (403, "insufficient permissions", "permission_denied", "permission_denied_rule_1"),
    (404, "not found", "api_changed", "api_changed_rule_1"),
    (404, "no route matched", "api_changed", "api_changed_rule_1"),
    (400, "unknown column name", "api_changed", "api_changed_rule_2"),
    (422, "field unknown", "api_changed", "api_changed_rule_2"),
    (400, "validation failed", "data_error", "data_error_rule_1"),
    (504, "Gateway Timeout", "network_timeout", "network_timeout_rule_1"),
    (502, "connection refused", "network_timeout", "network_timeout_rule_1"),
    (500, "TypeError: null is not a function", "script_error", "script_error_rule_1"),
    (200, "TypeError: foo is not a function", "script_error", "script_error_rule_1"),
    (418, "I'm a teapot", "unknown", None),
]


def test_rules(spark):
    rows = D.classify(spark.createDataFrame([(s, m) for s, m, *_ in VECTORS], "status_code int, error_message string")).collect()
    assert [(r.status_code, r.error_message, r.root_cause, r.matching_rule) for r in rows] == VECTORS
    assert [r.classifier for r in rows] == ["rule"] * 14 + ["fallback"]


@pytest.mark.parametrize(("given", "want"), [
    ('{"X-Auth-Token": "abc", "COOKIE" : "a=b; c", "Accept": "text"}', '{"X-Auth-Token": "***", "COOKIE" : "***", "Accept": "text"}'),
    ('{"user":"me","password":"p\\"q{[","apikey":-1.5e3,"ssn":null,"secret":true}', '{"user":"me","password":"***","apikey":"***","ssn":"***","secret":"***"}'),
    ('{"token":{"value":"s3cr3t","x":[1,{"y":"}"}]},"password":["p1","p2"],"n":1}', '{"token":"***","password":"***","n":1}'),
    ('{"a":[{"refreshToken":{}},{"idCard":[]},{"note":"token: {"}],"creditCard" : {"no":"4"}}', '{"a":[{"refreshToken":"***"},{"idCard":"***"},{"note":"token: {"}],"creditCard" : "***"}'),
    ('{"secret": {"broken": ', '{"secret": "***"'),
    ('{"tokens":1,"my_password":"kept"}', '{"tokens":1,"my_password":"kept"}'),
])
def test_redaction(spark, given, want):
    assert spark.createDataFrame([(given,), (None,)], "j string").select(D.redact_json(F.col("j"))).collect() == [(want,), (None,)]


def test_redaction_of_long_values(spark):
    given = '{"password":"' + 'x\\"' * 50_000 + '","n":{"phone":[' + ",".join(["1"] * 50_000) + ']}}'
    assert spark.createDataFrame([(given,)], "j string").select(D.redact_json(F.col("j"))).first()[0] == '{"password":"***","n":{"phone":"***"}}'


def test_dedup_keeps_the_first(spark):
    data = [(7, 5, "/cart", "PUT", 409), (3, 9, "/cart", "PUT", 409), (8, 1, "/cart", "PUT", 500), (9, 2, "/cart", "PATCH", 409), (1, 5, "/cart", "PUT", 409), (2, 0, None, "PUT", 409)]
    logs = spark.createDataFrame(data, "log_id long, created_at long, endpoint string, method string, status_code int")
    assert sorted(r.log_id for r in D.dedup(logs).collect()) == [1, 2, 8, 9]
    assert D.classify(D.dedup(logs.limit(0)).withColumn("error_message", F.lit(""))).count() == 0


def test_levels_and_keys(spark):
    rows = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "a boolean, b boolean").select(D.level(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == ["none", "partial", "severe", "severe"]
    keys = spark.createDataFrame([(s, m, e, t) for s in (500, 501) for m in "GP" for e in ("/p", "/q") for t in ("boom", "bang")] * 2, "s int, m string, e string, t string")
    assert keys.select(D.cache_key(F.col("s"), F.col("m"), F.col("e"), F.col("t"))).distinct().count() == 16


def test_rules_of_a_file(spark, tmp_path):
    import json

    from tessera.sources import files
    from tessera.streaming.limits import RuleCache

    path = tmp_path / "r.json"
    path.write_text(json.dumps({"rules": [{"id": "teapot", "category": "odd", "priority": 1, "confidence": 0.4, "status_code": [418], "error_message_patterns": ["tea"]}, {"id": "any", "category": "all", "error_message_patterns": ["."]}]}))
    cache = RuleCache(spark, str(path), seconds=1000)
    frame = spark.createDataFrame([(418, "TEA time"), (500, "tea"), (500, "")], "status_code int, error_message string")
    assert [r.matching_rule for r in D.classify(frame, cache.rules()).collect()] == ["teapot", "any", None]
    path.write_text("[]")
    assert len(cache.rules()) == 2 and files.rule_tuples(spark, str(path)) == []
    cache.seconds = 0
    assert cache.rules() == []


def test_http_errors_of_long_texts_in_linear_time(spark):
    """A long text without a method costs one pass; the look-ahead is only taken where a method stands."""
    pattern = D.http_errors(F.col("t"))._jc.toString()
    assert pattern.index("(?=(?:GET") < pattern.index("(?s:")
    text = "x" * 3000 + "\nget /a\t/b [12] [404] y [500] Error GET /c [1000] [200] fail\nPUT /d [503] fine\n" + "y" * 300
    row = spark.createDataFrame([(text,)], "t string").select(D.http_errors(F.col("t")).alias("e")).first().e
    assert [(e.method, e.path, e.status) for e in row] == [("GET", "/a", 404), ("GET", "/c", 200)]
    assert [len(e.message) for e in row] == [200, 200] and row[1].message.startswith("GET /c [1000]")
