"""Search over documents (text), suppliers and parts (names).

The index of documents is built at the first query of a session that asks it, in the session's shared folder, and asked again by later ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import index as I, search as S
from tessera.operators.rounds import folder
from tessera.plans.registry import query
from tessera.sources.tables import table

QUERY = "the thing tion"
_WORDS = "w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)"
_BM25 = f"""{_WORDS}, n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS len FROM w),
terms AS (SELECT t, count(*)::DOUBLE AS df FROM (SELECT unnest(list_distinct(w)) AS t FROM w) GROUP BY t),
idf AS (SELECT t, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM terms, n), mean AS (SELECT avg(raw) AS m FROM idf),
q AS (SELECT t, CASE WHEN raw < 0 THEN {S.FLOOR} * m ELSE raw END AS idf FROM idf, mean WHERE t IN ('the', 'thing', 'tion')),
parts AS (SELECT id, len, len(w) AS l, idf, len(list_filter(w, lambda x: x = t))::DOUBLE AS tf FROM w, n, q),
bm25 AS (SELECT id, round(100 * sum(idf * tf * {S.K1 + 1} / (tf + {S.K1} * ({1 - S.B} + {S.B} * l / len))), 6) AS score FROM parts GROUP BY id)"""
_FTS = """fts AS (SELECT id, round(100 * (a / (a + 1) + b / (b + 1)) / 2, 6) AS score FROM (SELECT id, len(list_filter(w, lambda x: x = 'thing'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'tion'))::DOUBLE AS b FROM w) WHERE a > 0 AND b > 0)"""
_FUSED = f"""a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM fts QUALIFY r <= 60), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm25 QUALIFY r <= 60),
fused AS (SELECT id, sum(1.0::DOUBLE / ({S.RRF_K} + r)) AS raw, round(100 * raw, 2) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY raw DESC, id LIMIT 40)"""
_BUILT: dict[tuple[str, str], I.Index] = {}


def _index(spark, sf_dir) -> I.Index:
    """The index of the documents of a folder, types are languages; built once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        _BUILT[key] = I.build(table(spark, sf_dir, "documents"), f"{folder(spark)}/index-{uuid.uuid4().hex}", "doc_id", "text", "lang")
    return _BUILT[key]


@query("index_terms", f"""WITH {_WORDS.replace("SELECT doc_id AS id,", "SELECT lang, doc_id AS id,")}
SELECT lang AS kind, t AS term, count(*) AS df FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM w) GROUP BY ALL""")
def index_terms(spark, sf_dir):
    """The index's dictionary: in how many documents of each type a term stands."""
    return _index(spark, sf_dir).part("terms").groupBy(F.expr("substr(kind, 2)").alias("kind"), "term").agg(F.sum("df").alias("df"))


@query("bm25_topk", f"WITH {_BM25} SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 50")
def bm25_topk(spark, sf_dir):
    return I.bm25(_index(spark, sf_dir), QUERY, 50)


_BM25_LANG = f"""{_WORDS.replace("SELECT doc_id AS id,", "SELECT lang, doc_id AS id,")}, n AS (SELECT lang, count(*)::DOUBLE AS n, avg(len(w)) AS len FROM w GROUP BY lang),
terms AS (SELECT lang, t, count(*)::DOUBLE AS df FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM w) GROUP BY ALL),
idf AS (SELECT lang, t, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM terms JOIN n USING (lang)), mean AS (SELECT lang, avg(raw) AS m FROM idf GROUP BY lang),
q AS (SELECT lang, t, CASE WHEN raw < 0 THEN {S.FLOOR} * m ELSE raw END AS idf FROM idf JOIN mean USING (lang) WHERE t IN ('the', 'thing', 'tion')),
parts AS (SELECT lang, id, len, len(w) AS l, idf, len(list_filter(w, lambda x: x = t))::DOUBLE AS tf FROM w JOIN n USING (lang) LEFT JOIN q USING (lang)),
bm25 AS (SELECT lang, id, round(100 * coalesce(sum(idf * tf * {S.K1 + 1} / (tf + {S.K1} * ({1 - S.B} + {S.B} * l / len))), 0), 6) AS score FROM parts GROUP BY ALL)"""


@query("bm25_topk_by_type", f"WITH {_BM25_LANG} SELECT lang AS kind, id, score FROM bm25 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, id) <= 20")
def bm25_topk_by_type(spark, sf_dir):
    """Each language is an index of its own: its number of documents, lengths and idf."""
    index = _index(spark, sf_dir)
    kinds = [k[1:] for k in sorted(index.kinds) if k.startswith("=")]
    found = [I.bm25(index, QUERY, 20, k).select(F.lit(k).alias("kind"), "id", "score") for k in kinds]
    both = found[0]
    for f in found[1:]:
        both = both.union(f)
    return both


@query("fts_and_match", f"WITH {_WORDS}, {_FTS} SELECT id, score FROM fts")
def fts_and_match(spark, sf_dir):
    return I.full_text(_index(spark, sf_dir), QUERY)


@query("rrf_fusion", f"WITH {_BM25}, {_FTS}, {_FUSED} SELECT id, score FROM fused")
def rrf_fusion(spark, sf_dir):
    index = _index(spark, sf_dir)
    return S.fuse([S.top(I.full_text(index, QUERY), 60), I.bm25(index, QUERY, 60)], 40).select("id", "score")


@query("hybrid_topk", f"WITH {_BM25}, {_FTS}, {_FUSED} SELECT id, score FROM fused ORDER BY raw DESC, id LIMIT 20")
def hybrid_topk(spark, sf_dir):
    return I.hybrid(_index(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", F.substring("text", 1, 40), QUERY, 20)


@query("name_search", "SELECT c_custkey AS id, 50.0 AS score FROM customer WHERE c_name ILIKE '%USTOMER%1%' ORDER BY c_name, c_custkey LIMIT 40")
def name_search(spark, sf_dir):
    return S.by_name(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_name"), "USTOMER%1", 40)


@query("hybrid_filled", f"""
WITH fused AS (SELECT r_regionkey::BIGINT AS id, round(100.0::DOUBLE / ({S.RRF_K} + row_number() OVER (ORDER BY r_regionkey)), 2) AS score FROM region),
names AS (SELECT (100 + n_nationkey)::BIGINT AS id, 50.0::DOUBLE AS score FROM nation WHERE n_name ILIKE '%1%' ORDER BY n_name, n_nationkey LIMIT 20)
SELECT id, score FROM (SELECT * FROM fused UNION ALL SELECT * FROM names) ORDER BY score DESC, id LIMIT 20""")
def hybrid_filled(spark, sf_dir):
    """Too few documents, so names of another table fill up."""
    docs = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), "r_name")
    others = table(spark, sf_dir, "nation").select((100 + F.col("n_nationkey")).cast("long").alias("id"), "n_name")
    return S.hybrid(docs, "id", "r_name", F.col("n_name"), "1", 20, others=others)


@query("fts_top_up", f"""
WITH {_WORDS}, fts AS (SELECT id, round(100 * a / (a + 1), 6) AS score FROM (SELECT id, len(list_filter(w, lambda x: x = 'stupid'))::DOUBLE AS a FROM w) WHERE a > 0 ORDER BY score DESC, id LIMIT 10),
names AS (SELECT doc_id AS id, 50.0::DOUBLE AS score FROM documents WHERE substr(text, 1, 40) ILIKE '%stupid%' ORDER BY substr(text, 1, 40), doc_id LIMIT 10)
SELECT id, score FROM fts UNION ALL SELECT id, score FROM names WHERE id NOT IN (SELECT id FROM fts)""")
def fts_top_up(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.fill(S.top(I.full_text(_index(spark, sf_dir), "the stupid"), 10), S.by_name(docs, "doc_id", F.substring("text", 1, 40), "stupid", 10))


@query("list_by_type", "SELECT p_partkey, p_name FROM part WHERE p_type = (SELECT min(p_type) FROM part) ORDER BY p_name, p_partkey LIMIT 30")
def list_by_type(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    kind = parts.agg(F.min("p_type")).first()[0]
    return parts.filter(F.col("p_type") == kind).orderBy("p_name", "p_partkey").limit(30).select("p_partkey", "p_name")


@query("exact_then_best_pick", """
WITH s AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS score FROM part ORDER BY score DESC, id LIMIT 5)
SELECT id, score, name FROM s ORDER BY (name <> (SELECT name FROM s ORDER BY score, id DESC LIMIT 1)), score DESC, id LIMIT 1""")
def exact_then_best_pick(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    scored = parts.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    name = S.top(scored, 5).join(parts, F.col("id") == F.col("p_partkey")).orderBy("score", F.desc("id")).first()["p_name"]
    return S.pick(parts, scored, "p_partkey", "p_name", name)


@query("node_context", """
WITH edges AS (SELECT DISTINCT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target FROM lineitem UNION SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem),
node AS (SELECT 'p:' || max(p_partkey) AS id FROM part)
SELECT id, source, target FROM node JOIN edges ON source = id OR target = id ORDER BY source, target LIMIT 50""")
def node_context(spark, sf_dir):
    """A part and the first fifty edges that touch it: orders that call it, suppliers that it calls."""
    lines = table(spark, sf_dir, "lineitem")
    id_ = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    key = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    own = lines.filter(F.col("l_partkey") == key)
    edges = own.select(id_("o:", "l_orderkey").alias("source"), id_("p:", "l_partkey").alias("target")).union(own.select(id_("p:", "l_partkey"), id_("s:", "l_suppkey"))).distinct()
    return edges.orderBy("source", "target").limit(50).select(F.lit(f"p:{key}").alias("id"), "source", "target")


@query("node_source_lines", """
WITH n AS (SELECT doc_id AS id, 1 + doc_id % 5 AS start, 1 + doc_id % 5 + doc_id % 3 AS stop, string_split(text, chr(10)) AS l FROM documents)
SELECT id, greatest(start - 2, 1)::INTEGER AS first, coalesce(array_to_string(l[greatest(start - 2, 1) : stop], chr(10)), '') AS lines FROM n""")
def node_source_lines(spark, sf_dir):
    """The source of nodes that lie in documents, with two lines before."""
    docs = table(spark, sf_dir, "documents")
    start = 1 + F.col("doc_id") % 5
    nodes = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file"), start.alias("start"), (start + F.col("doc_id") % 3).alias("stop"))
    found = S.source_lines(nodes, docs.select(F.col("doc_id").alias("file"), "text"))
    return found.select("id", "first", F.array_join("lines", "\n").alias("lines"))
