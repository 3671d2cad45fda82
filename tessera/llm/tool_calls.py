"""Operator 4, tool-call linking: join calls and results, order calls, validate, serialise.

Calls and results meet in a hash join by their identifier inside a conversation. Calls get a level:
0 without dependencies, else one more than the highest level among the calls they depend on; sorted
by (level, call_id) every call follows what it needs. Levels are found by peeling: each round
removes the dependencies met by the round before, in two joins, and writes what is left to the
shared folder. Rounds are as many as there are levels. Arguments are parsed as JSON and checked
against the schema of the tool; each call with its arguments and result is serialised as canonical
JSON: keys in order, no blanks, and each number in one form. A number keeps all its digits: it is
written plainly (``100`` for ``1e2`` and ``100.0``), with an exponent only from 10^21 or below 10^-6.

All keys are (conversation, call) pairs, so a conversation with a third of all rows is spread over
tasks like any other; what is joined is aggregated to one row a key first. Schemas are a fixed
library of tools and are literals of the plan.

Nulls: a null conversation, call_id, name or arguments counts as the empty text; a null result is
no result. Several calls with one identifier are one call, the least by name and arguments, and
``n_calls`` says how many; of several results the least counts, and ``n_results`` says how many. A
result without a call is a row of its own with ``n_calls`` 0 and the error ``call``. A dependency on
a call that isn't there is counted in ``n_missing`` and not waited for. Calls on a cycle, or that
need one, have a null level. Arguments that are no JSON object have the error ``object`` and are left
out of the message; so do objects that repeat a key at any depth, are nested deeper than the parser
goes (1,000 levels), or hold the noncharacter U+FFFF, raw or escaped, which no JSON for interchange
may. Texts of any length are kept whole. Other columns are not read, whatever their names. Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm._shared import let, table, written

#: Tools, their fields as (name, type, required).
SCHEMAS = {
    "ask": (("text", "string", True), ("turn", "integer", True), ("after", "string", False)),
    "search": (("query", "string", True), ("limit", "integer", False)),
    "compute": (("expression", "string", True), ("precision", "number", False), ("exact", "boolean", False)),
    "store": (("key", "string", True), ("value", "object", True), ("tags", "array", False)),
}
_MARK = "\uffff"
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^"0-9-]+|-'
_NUMBER = r"^(-?)([0-9]+)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"


def plain_number(token: Column) -> Column:
    """The one form of a JSON number: equal numbers have equal forms, and no digit is lost."""
    part = lambda i: F.regexp_extract(token, _NUMBER, i)
    given = F.struct(part(1).alias("sign"), part(2).alias("whole"), F.concat(part(2), part(3)).alias("all"), F.when(part(4) == "", 0).otherwise(part(4).try_cast("long")).alias("exp"))

    def of_parts(p: Column) -> Column:
        cut = F.ltrim(p["all"], F.lit("0"))
        at = F.length(p["whole"]) - (F.length(p["all"]) - F.length(cut)) + p["exp"]
        return let(F.struct(p["sign"].alias("sign"), F.rtrim(cut, F.lit("0")).alias("d"), at.alias("n")), written_out)

    def written_out(x: Column) -> Column:
        d, n, k = x["d"], x["n"], F.length(x["d"])
        zeros = lambda i: F.repeat(F.lit("0"), F.greatest(i, F.lit(0)).cast("int"))
        more = F.when(k > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
        power = F.concat(F.substr(d, F.lit(1), F.lit(1)), more, F.when(n > 0, "e+").otherwise("e-"), F.abs(n - 1).cast("string"))
        form = F.when((k <= n) & (n <= 21), F.concat(d, zeros(F.least(n, F.lit(21)) - k))).when((n > 0) & (n <= 21), F.concat(F.substr(d, F.lit(1), n.cast("int")), F.lit("."), F.substr(d, n.cast("int") + 1)))
        form = form.when((n > -6) & (n <= 0), F.concat(F.lit("0."), zeros(-n), d)).otherwise(power)
        return F.when(k == 0, "0").otherwise(F.concat(x["sign"], form))

    return F.coalesce(let(given, of_parts), token)


def _marked(json: Column) -> Column:
    """JSON with each number as a string behind a mark, in its one form."""
    tokens = F.regexp_extract_all(json, F.lit(_TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit("^-?[0-9]")), F.concat(F.lit(f'"{_MARK}'), plain_number(t), F.lit('"'))).otherwise(t)), "")


def _object(json: Column) -> Column:
    """A JSON object as a variant whose numbers are marked strings; null if it is none."""
    in_list = lambda j: F.try_parse_json(F.concat(F.lit("["), j, F.lit("]")))  # noqa: E731  # the parser stops at a value's end, but not in a list
    refused = F.contains(json, F.lit(_MARK)) | F.rlike(json, F.lit(r"(?i)\\uffff"))
    found = F.when(~refused & in_list(json).isNotNull() & F.rlike(json, F.lit(r"^\s*\{")), _marked(json))
    alone = F.concat(F.lit("["), F.to_json(F.try_parse_json(found)), F.lit("]")) == F.to_json(in_list(found))
    return F.when(alone, F.try_parse_json(found))


def canonical(json: Column) -> Column:
    """A JSON object with its keys in order, no blanks and numbers in one form; null if it is no object."""
    return F.regexp_replace(F.to_json(_object(json)), f'"{_MARK}([^"]*)"', "$1")


def errors(name: Column, arguments: Column) -> Column:
    """What is wrong with the arguments: object, tool, missing:f, type:f or unexpected:f, sorted, comma-joined."""
    spec = F.lit(None)
    for tool, fields in SCHEMAS.items():
        spec = F.when(name == tool, F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("kind"), F.lit(r).alias("required")) for f, t, r in fields])).otherwise(spec)

    def kind_of(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        text = F.try_variant_get(value, "$", "string")
        digits = F.length(F.regexp_extract(text, r"\.([0-9]+)e", 1))
        whole = F.rlike(text, F.lit("^.-?[0-9]+$")) | (F.rlike(text, F.lit(r"e\+")) & (digits <= F.regexp_extract(text, r"e\+([0-9]+)$", 1).try_cast("long")))
        number = F.when(whole, "integer").otherwise("number")
        return F.when((kind == "STRING") & F.startswith(text, F.lit(_MARK)), number).otherwise(F.lower(F.regexp_extract(kind, "^[A-Z]+", 0)))

    def fault(given: Column):
        def of(s: Column) -> Column:
            value = F.element_at(given, s["field"])
            kind = kind_of(value)
            right = (kind == s["kind"]) | ((kind == "integer") & (s["kind"] == "number"))
            there = F.map_contains_key(given, s["field"])
            return F.when(~there & s["required"], F.concat(F.lit("missing:"), s["field"])).when(there & ~F.coalesce(right, F.lit(False)), F.concat(F.lit("type:"), s["field"]))

        return of

    def of_given(given: Column) -> Column:
        known = F.transform(spec, lambda s: s["field"])
        more = F.transform(F.array_except(F.map_keys(given), known), lambda k: F.concat(F.lit("unexpected:"), k))
        found = F.array_compact(F.concat(F.transform(spec, fault(given)), more))
        return F.when(given.isNull(), "object").when(spec.isNull(), "tool").otherwise(F.array_join(F.array_sort(found), ","))

    return let(_object(arguments).cast("map<string,variant>"), of_given)


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of every call not on a cycle; needs: ``(conv_id, call_id, need)`` on calls that are there."""
    key = ["conv_id", "call_id"]
    left = written(needs.distinct(), "needs")
    fresh = written(calls.select(key).join(left, key, "left_anti").withColumn("level", F.lit(0)), "level")
    found, level = fresh, 0
    while not left.isEmpty():
        level += 1
        done = fresh.select("conv_id", F.col("call_id").alias("need"))
        rest = written(left.join(done, ["conv_id", "need"], "left_anti"), "needs")
        fresh = written(left.select(key).distinct().join(rest, key, "left_anti").withColumn("level", F.lit(level)), "level")
        if fresh.isEmpty():
            break
        found, left = found.union(fresh), rest
    return found


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per call, and per result without one.

    calls: ``(conv_id, call_id, name, arguments, depends_on array<string>)``; results: ``(conv_id,
    call_id, content)``. Returns conv_id and call_id as text, level, name, n_calls, n_results,
    n_missing, errors (empty: valid) and message, the canonical JSON.
    """
    key = ["conv_id", "call_id"]
    call = F.min(F.struct(_key("name").alias("name"), _key("arguments").alias("arguments"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")))
    one = written(calls.groupBy(_key("conv_id").alias("conv_id"), _key("call_id").alias("call_id")).agg(call.alias("c"), F.count("*").alias("n_calls")).select(*key, "c.*", "n_calls"), "calls")
    hashed = lambda df: df.hint("shuffle_hash")
    content = results.filter(F.col("content").isNotNull()).groupBy(_key("conv_id").alias("conv_id"), _key("call_id").alias("call_id")).agg(F.min("content").alias("result"), F.count("*").alias("n_results"))
    needs = one.select(*key, F.explode(F.array_distinct(F.array_compact("depends_on"))).alias("need"))
    ids = one.select("conv_id", F.col("call_id").alias("need"))
    there = needs.join(hashed(ids), ["conv_id", "need"], "left_semi").select(*key, "need")
    missing = needs.join(hashed(ids), ["conv_id", "need"], "left_anti").groupBy(key).agg(F.count("*").alias("n_missing"))
    joined = one.join(hashed(content), key, "full").join(hashed(levels(one, there)), key, "left").join(hashed(missing), key, "left")
    checked = joined.withColumn("arguments", canonical(F.col("arguments"))).withColumn("errors", F.when(F.col("n_calls").isNull(), "call").otherwise(errors(F.col("name"), F.coalesce("arguments", F.lit("")))))
    rest = F.to_json(F.struct("call_id", "level", "name", "result"))
    message = F.when(F.col("arguments").isNull(), rest).otherwise(F.concat(F.lit('{"arguments":'), F.col("arguments"), F.lit(","), F.substr(rest, F.lit(2))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = written(checked.select(*key, "level", "name", zero("n_calls"), zero("n_results"), zero("n_missing"), "errors", message.alias("message")), "linked")
    return rows.orderBy("conv_id", "level", "call_id")


#: What the made calls say besides plain asks, as (tool, arguments); {text} and {turn} stand for JSON values.
MADE = {
    1: ("search", '{"query" : {text}, "limit": 1e1}'),
    2: ("compute", '{"expression":"2 * 21","precision":2.50,"exact":true}'),
    3: ("store", '{"value":{"b":[1.0,-0,12345678901234567890123],"a":null},"key":"k-{turn}","tags":[]}'),
    4: ("search", '{"limit":"ten","page":2}'),
    5: ("compute", '{"expression":7,"exact":"no"}'),
    6: ("store", '{"key":"k","value":[1],"tags":{}}'),
    7: ("fly", '{"to":"moon"}'),
    8: ("search", '{"query":"a","query":"b"}'),
    9: ("compute", "[1,2]"),
    10: ("ask", '{"text":'),
    11: ("store", None),
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table without tool calls: a user's turn t calls, turn t + 1 of the assistant answers.

    Twelve kinds of calls take turns, by conversation and half the turn: asks, and those of MADE, right and faulty. A call
    depends on the call of turn t // 2, if there is one; kind 2 also on one that never is, kind 6 on itself, kind 9 on that of
    turn 2 t, which depends on it.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    of_turn = lambda t: F.concat_ws("-", number("conv_id"), t.cast("string"))
    call_id = F.concat_ws("-", number("conv_id"), number("turn"))
    kind = F.coalesce(F.pmod(F.col("conv_id") + F.floor(F.col("turn") / 2), F.lit(len(MADE) + 1)), F.lit(0)).cast("int")
    before = F.when(F.col("turn") > 0, of_turn(F.floor(F.col("turn") / 2)))
    turn, text = number("turn"), F.regexp_replace(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1")
    name, arguments = F.lit("ask"), F.to_json(F.struct("turn", "text", before.alias("after")))
    for k, (tool, made) in MADE.items():
        name = F.when(F.col("kind") == k, tool).otherwise(name)
        filled = F.replace(F.replace(F.lit(made), F.lit("{turn}"), turn), F.lit("{text}"), text)
        arguments = F.when(F.col("kind") == k, filled).otherwise(arguments)
    needs = F.when(F.col("kind") == 2, F.array(before, F.lit("none"))).when(F.col("kind") == 6, F.array(call_id)).when(F.col("kind") == 9, F.array(of_turn(F.col("turn") * 2))).otherwise(F.array(before))
    calls = conversations.filter("role = 'user'").withColumn("kind", kind).select("conv_id", call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.array_compact(needs).alias("depends_on"))
    answered = F.concat_ws("-", number("conv_id"), F.coalesce((F.col("turn") - 1).cast("string"), F.lit("null")))
    results = conversations.filter("role = 'assistant'").select("conv_id", answered.alias("call_id"), F.col("text").alias("content"))
    return calls, results


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*calls_of(table(spark, sf_dir, "conversations")))


#: Of each kind of made calls, its errors and its canonical arguments, with {text} and {turn} as in MADE.
EXPECTED = {
    1: ("", '{"limit":10,"query":{text}}'),
    2: ("", '{"exact":true,"expression":"2 * 21","precision":2.5}'),
    3: ("", '{"key":"k-{turn}","tags":[],"value":{"a":null,"b":[1,0,1.2345678901234567890123e+22]}}'),
    4: ("missing:query,type:limit,unexpected:page", '{"limit":"ten","page":2}'),
    5: ("type:exact,type:expression", '{"exact":"no","expression":7}'),
    6: ("type:tags,type:value", '{"key":"k","tags":{},"value":[1]}'),
    7: ("tool", '{"to":"moon"}'),
    **{k: ("object", None) for k in (8, 9, 10, 11)},
}


def _sql() -> str:
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    fill = lambda x: f"replace(replace({quote(x)}, '{{turn}}', coalesce(turn::VARCHAR, 'null')), '{{text}}', to_json(coalesce(text, ''))::VARCHAR)"
    case = lambda values, rest: "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {rest} END"
    given = """'{' || array_to_string(list_filter([CASE WHEN turn IS NOT NULL THEN '"turn":' || turn END, CASE WHEN text IS NOT NULL THEN '"text":' || to_json(text) END, CASE WHEN need IS NOT NULL THEN '"after":' || to_json(need) END], lambda x: x IS NOT NULL), ',') || '}'"""
    plain = """'{' || array_to_string(list_filter([CASE WHEN need IS NOT NULL THEN '"after":' || to_json(need) END, CASE WHEN text IS NOT NULL THEN '"text":' || to_json(text) END, CASE WHEN turn IS NOT NULL THEN '"turn":' || turn END], lambda x: x IS NOT NULL), ',') || '}'"""
    wrong = "concat_ws(',', CASE WHEN text IS NULL THEN 'missing:text' END, CASE WHEN turn IS NULL THEN 'missing:turn' END)"
    return f"""
WITH RECURSIVE raw AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv_id, coalesce(conv_id::VARCHAR, 'null') || '-' || coalesce(turn::VARCHAR, 'null') AS call_id, turn, text,
    coalesce((conv_id + turn // 2) % {len(MADE) + 1}, 0) AS kind,
    CASE WHEN turn > 0 THEN coalesce(conv_id::VARCHAR, 'null') || '-' || (turn // 2) END AS need, coalesce(conv_id::VARCHAR, 'null') || '-' || (turn * 2) AS later
  FROM conversations WHERE role = 'user'
),
made AS (
  SELECT conv_id, call_id, CASE kind WHEN 6 THEN call_id WHEN 9 THEN later ELSE need END AS need, kind = 2 AS more,
    {case({k: quote(t) for k, (t, _) in MADE.items()}, "'ask'")} AS name,
    coalesce({case({k: fill(a) for k, (_, a) in MADE.items()}, given)}, '') AS given,
    {case({k: fill(a) for k, (_, a) in EXPECTED.items()}, plain)} AS canonical,
    {case({k: quote(e) for k, (e, _) in EXPECTED.items()}, wrong)} AS errors FROM raw
),
one AS (
  SELECT conv_id, call_id, c.need, c.name, c.canonical, c.errors, c.more, n_calls FROM (
    SELECT conv_id, call_id, count(*) AS n_calls, arg_min({{'need': need, 'name': name, 'canonical': canonical, 'errors': errors, 'more': more}}, {{'name': name, 'given': given}}) AS c FROM made GROUP BY ALL
  )
),
results AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv_id, coalesce(conv_id::VARCHAR, 'null') || '-' || coalesce((turn - 1)::VARCHAR, 'null') AS call_id, min(text) AS result, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1, 2
),
waiting AS (SELECT *, need IS NOT NULL AND EXISTS (SELECT 1 FROM one p WHERE p.conv_id = o.conv_id AND p.call_id = o.need) AS waits FROM one o),
depth AS (
  SELECT conv_id, call_id, 0 AS level FROM waiting WHERE NOT waits
  UNION ALL
  SELECT o.conv_id, o.call_id, level + 1 FROM waiting o JOIN depth d ON d.conv_id = o.conv_id AND d.call_id = o.need WHERE waits
)
SELECT conv_id, call_id, level, name, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  coalesce((need IS NOT NULL AND NOT waits)::BIGINT + more::BIGINT, 0) AS n_missing, CASE WHEN n_calls IS NULL THEN 'call' ELSE errors END AS errors,
  '{{' || coalesce('"arguments":' || canonical || ',', '') || '"call_id":' || to_json(call_id) || coalesce(',"level":' || level, '') || coalesce(',"name":' || to_json(name), '') || coalesce(',"result":' || to_json(result), '') || '}}' AS message
FROM waiting FULL JOIN results USING (conv_id, call_id) LEFT JOIN depth USING (conv_id, call_id)
"""


SQL = _sql()
