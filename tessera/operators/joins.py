"""Joins that carry a rule: lookups with defaults, set differences, overlaps, cascades."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def children_list(parents: DataFrame, key: str, children: DataFrame, child_key: str, name: str, fields: Sequence[str]) -> DataFrame:
    """Parents with their children as a sorted list of structs; an empty list without any. Children are gathered before the join."""
    kind = children.select(F.array(F.struct(*fields)).alias("x")).schema["x"].dataType.simpleString()
    lists = children.groupBy(F.col(child_key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def lookup(df: DataFrame, column: str, names: DataFrame, key: str, value: str, as_: str) -> DataFrame:
    """The value of a key, or the key itself where it is missing."""
    right = names.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return df.join(right, F.col(column) == F.col("_k"), "left").withColumn(as_, F.coalesce(F.col("_v").cast("string"), F.col(column).cast("string"))).drop("_k", "_v")


#: Rows up to which a table of choices is one; more are refused.
CHOICES = 1_000


def missing_pairs(left: DataFrame, choices: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of left with each value of a small table of one column that present doesn't hold yet; each row is multiplied where it is, so no cross join."""
    name = choices.columns[0]
    values = sorted(r[0] for r in choices.distinct().limit(CHOICES + 1).collect())
    if len(values) > CHOICES:
        raise ValueError(f"more than {CHOICES} choices")
    each = left.withColumn(name, F.explode(F.array(*map(F.lit, values)))) if values else left.withColumn(name, F.lit(None).cast(choices.schema[0].dataType)).limit(0)
    return each.join(present, [*left.columns, name], "left_anti")


def overlapping(ranges: DataFrame, spans: DataFrame, key: str, bucket: int | None = None) -> DataFrame:
    """Pairs of a range and a span of the same key that overlap; both have start and stop.

    Ends are cut into buckets, so that a key with many rows is an equi-join on (key, bucket); a pair
    that meets in several buckets is kept in the first. A bucket is as wide as the mean length (64 at
    least), unless given, so that a row falls into two buckets on average, whatever the scale.
    """
    if bucket is None:
        long = [df.agg(F.avg(F.col("stop") - F.col("start"))).first()[0] or 0 for df in (ranges, spans)]
        bucket = max(64, math.ceil(max(long)))

    def cut(df: DataFrame, prefix: str) -> DataFrame:
        buckets = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket)))
        valid = df.filter(F.col("start").isNotNull() & F.col("stop").isNotNull() & (F.col("start") <= F.col("stop")))
        return valid.withColumn("_bucket", buckets).select(F.col(key), "_bucket", *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])

    a, b = cut(ranges, "range"), cut(spans, "span")
    meet = (F.col("range_start") <= F.col("span_stop")) & (F.col("range_stop") >= F.col("span_start"))
    first = F.col("_bucket") == F.floor(F.greatest("range_start", "span_start") / bucket)
    return a.join(b, [key, "_bucket"]).filter(meet & first).drop("_bucket")


def version_diff(base: DataFrame, target: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """``(keys, change)``: added, removed or modified; nulls compare equal. One full join of two keyed tables."""
    struct = F.struct(*compared)
    a = base.select(*keys, struct.alias("_a"))
    b = target.select(*keys, struct.alias("_b"))
    joined = a.join(b, list(keys), "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return joined.select(*keys, change.alias("change")).filter("change is not null")


def first_rule(rows: DataFrame, keys: Sequence[str], rules: Sequence[tuple[int, DataFrame, Sequence[str], str]], value: str) -> DataFrame:
    """The first of several ordered joins that finds something for a row.

    rules: (number, table, join columns, its value column). Ties inside a rule go to the least value.
    """
    hits = None
    for number, other, on, column in rules:
        part = rows.join(other.select(*on, F.col(column).alias(value)), list(on)).select(*keys, F.lit(number).alias("rule"), value)
        hits = part if hits is None else hits.unionByName(part)
    best = hits.groupBy(*keys).agg(F.min(F.struct("rule", value)).alias("b"))
    return rows.join(best.select(*keys, "b.*"), list(keys), "left")


def first_candidate(rows: DataFrame, key: str, candidates: Column, existing: DataFrame, name: str) -> DataFrame:
    """For each row the first of an array of candidates that exists, or null."""
    each = rows.select(key, F.posexplode(candidates).alias("_i", name))
    found = each.join(existing.select(F.col(existing.columns[0]).alias(name)).distinct(), name, "left_semi")
    best = found.groupBy(key).agg(F.min(F.struct("_i", name)).alias("b")).select(key, F.col(f"b.{name}").alias(name))
    return rows.join(best, key, "left")


#: Endings and index files that a module's name may stand for, in the order they are tried.
ENDINGS = ("", ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts")
INDEX_FILES = ("/__init__.py", "/index.js", "/index.jsx", "/index.ts", "/index.tsx", "/index.mjs")


def module_files(module: Column) -> Column:
    """The files that a module may mean, in the order they are tried."""
    return F.array(*[F.concat(module, F.lit(e)) for e in (*ENDINGS, *INDEX_FILES)])


#: How sure each rule of ``resolve_calls`` is.
CONFIDENCE = {1: "high", 2: "high", 3: "medium", 4: "high", 5: "high", 6: "medium", 7: "low"}


def resolve_calls(calls: DataFrame, symbols: DataFrame, locals_: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls with ``(rule, symbol, confidence)`` of the first rule that finds a symbol; nulls where none does.

    calls: (id, file, cls, scope, name); cls: the class around the call. symbols: (kind, file, owner, name), kind class, func or
    method. locals_: (file, variable, type as file::Class). imports: (file, alias, target). Rules: 1 a method of the same class,
    by self or cls, and nothing else for those; 2 a method of a local variable's class; 3 an imported class, function or method;
    4 a function of the file; 5 a method of a class of the file; 6 what an imported name holds; 7 the least function or method
    of that name anywhere.

    Rules name symbols by id, so all but the last are one look-up of each call's candidates; the last joins one row per name.
    """
    scoped = F.when(F.col("owner").isNull(), F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    ids = symbols.select(F.concat(F.col("kind"), F.lit("://"), F.col("file"), F.lit("::"), scoped).alias("symbol"), "kind", "name").distinct()
    types = locals_.groupBy("file", F.col("variable").alias("scope")).agg(F.min("type").alias("type"))
    targets = imports.groupBy("file", F.col("alias").alias("said")).agg(F.min("target").alias("target"))
    anywhere = ids.filter("kind <> 'class'").groupBy("name").agg(F.min("symbol").alias("least"))
    rows = calls.withColumn("said", F.coalesce("scope", "name")).join(types, ["file", "scope"], "left").join(targets, ["file", "said"], "left").join(anywhere, "name", "left")
    own, plain = F.col("scope").isin("self", "cls"), F.col("scope").isNull()
    other = ~own & ~plain
    named = lambda kind, file, *more: F.concat(F.lit(f"{kind}://"), file, F.lit("::"), *more)
    file, target, name, scope, dot = F.col("file"), F.col("target"), F.col("name"), F.col("scope"), F.lit(".")
    none = F.lit(None).cast("string")
    tried = [
        (11, own, named("method", file, F.col("cls"), dot, name), none),
        (21, other, F.concat(F.lit("method://"), F.col("type"), dot, name), none),
        *[(31 + i, plain, named(kind, target, name), none) for i, kind in enumerate(("class", "func", "method"))],
        (41, plain, named("func", file, name), none),
        (51, other, named("method", file, scope, dot, name), named("class", file, scope)),
        (61, other, named("method", target, name), none),
        (62, other, named("method", target, scope, dot, name), named("class", target, scope)),
        (63, other, named("func", target, name), none),
        (71, ~own | plain, F.col("least"), none),
    ]
    array = F.array_compact(F.array(*[F.when(F.coalesce(fits, F.lit(False)) & symbol.isNotNull(), F.struct(F.lit(place).alias("place"), symbol.alias("symbol"), needs.alias("needs"))) for place, fits, symbol, needs in tried]))
    each = rows.select("id", F.explode(array).alias("c")).select("id", "c.*")
    known = ids.select("symbol")
    hits = each.join(known, "symbol", "left_semi")
    with_class = hits.filter("needs is not null").join(known.withColumnRenamed("symbol", "needs"), "needs", "left_semi").select("id", "place", "symbol")
    best = hits.filter("needs is null").select("id", "place", "symbol").union(with_class).groupBy("id").agg(F.min(F.struct("place", "symbol")).alias("b"))
    rule = F.floor(F.col("b.place") / 10)
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), rule.cast("int"))
    return calls.join(best.select("id", rule.alias("rule"), F.col("b.symbol").alias("symbol"), sure.alias("confidence")), "id", "left")


def induced(edges: DataFrame, nodes: DataFrame, node: str, source: str = "source", target: str = "target") -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(ids, F.col(source) == F.col("_n"), "left_semi").join(ids, F.col(target) == F.col("_n"), "left_semi")


def prefix_counts(prefixes: DataFrame, prefix: str, rows: DataFrame, text: str, n: str) -> DataFrame:
    """``(prefix, total)``: the sum of n over the rows whose text begins with a prefix, in any case; prefixes without any are left out.

    Each text is cut to the lengths that prefixes have (as many as the longest has characters at most), so the join is one of equal keys.
    """
    lengths = F.array_sort(F.collect_set(F.length(prefix)))
    known = [x for x in (prefixes.agg(lengths.alias("l")).first().l or [])]
    cut = F.explode(F.array(*[F.lit(x) for x in known]).cast("array<int>"))
    parts = rows.select(F.col(n).alias("n"), F.lower(text).alias("t"), cut.alias("l")).filter(F.length("t") >= F.col("l")).groupBy(F.expr("substr(t, 1, l)").alias("key")).agg(F.sum("n").alias("total"))
    return prefixes.select(F.col(prefix), F.lower(prefix).alias("key")).join(parts, "key").select(prefix, "total")
