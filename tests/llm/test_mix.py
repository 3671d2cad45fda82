import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mix


def brute(doc_id, rate, seed=mix.SEED):
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
    total, k = 0.0, 0
    while True:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        if u < total or k > rate + 12 * rate**0.5 + 30:
            return k
        k += 1


def test_query_equals_oracle(spark):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet')")
    want = db.execute(mix.SQL).df().sort_values(["doc_id", "copy"], ignore_index=True)
    got = mix.query(spark, d).toPandas().sort_values(["doc_id", "copy"], ignore_index=True)[want.columns.tolist()]
    assert got.equals(want.astype(got.dtypes.to_dict()))


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "none": 5.0}])
def test_counts_equal_brute_force_and_meet_targets(spark, weights):
    data = [(i, f"t{i}", "a" if i % 3 else "b") for i in range(3000)] + [(None, None, "a"), (9, "", None), (5, "again", "b")]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("copy", F.lit("x"))
    rows = mix.replicate(frame, weights, total=6000).collect()
    sizes = Counter(s for *_, s in data)
    share = {s: n**0.5 for s, n in sizes.items()} if weights is None else {s: weights.get(s, 0) for s in sizes}
    rate = {s: 6000 * share[s] / sum(share.values()) / sizes[s] for s in sizes}
    got = Counter((r.doc_id, r.text, r.source) for r in rows)
    assert got == Counter({x: brute(x[0], rate[x[2]]) for x in data if rate[x[2]]}) - Counter()
    for s in ("a", "b"):
        have = sum(n for (*_, t), n in got.items() if t == s)
        assert abs(have - rate[s] * sizes[s]) < 5 * (rate[s] * sizes[s]) ** 0.5
    keys = [r.mix_key for r in rows]
    assert all(0 <= k < 1 for k in keys) and len(set(keys)) > 0.99 * len(keys)


def test_large_rates_and_empty_tables(spark):
    frame = spark.createDataFrame([(i, "s") for i in range(5)], "doc_id long, source string")
    assert Counter(r.doc_id for r in mix.replicate(frame, {"s": 1.0}, total=10_000).collect()) == Counter({i: brute(i, 2000.0) for i in range(5)})
    assert mix.replicate(frame.limit(0)).count() == 0
    assert mix.replicate(frame, {}).count() == mix.replicate(frame, {"s": 0.0}).count() == 0


def test_any_names_and_types_stay_and_hot_keys_are_split(spark):
    data = [(None if i % 3 else i, f"t{i % 7}" if i % 2 else "same", "a", i, "x", {"k": i}, [i]) for i in range(2000)]
    names = "doc_id long, text string, source string, _n int, `_u.v` string, _steps map<string,int>, _source array<int>"
    frame = spark.createDataFrame(data, names).withColumns({"row": F.lit(1), "tie": F.lit(2), "salt": F.lit(3), "id": F.lit(4), "of": F.lit(5), "n": F.lit(6)})
    out = mix.replicate(frame, {"a": 1.0}, total=4000)
    assert out.columns == [*frame.columns, "copy", "mix_key"]
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    n_null, sizes = brute(None, 2.0), Counter(r.part for r in rows)
    assert Counter(r["_n"] for r in rows) == Counter({i: n for i in range(2000) if (n := n_null if i % 3 else brute(i, 2.0))})
    assert all(r["_steps"] == {"k": r["_n"]} and r["_source"] == [r["_n"]] and r["of"] == 5 for r in rows)
    assert n_null == 0 or max(sizes.values()) < 0.6 * len(rows)
    by_part = [[r.mix_key for r in rows if r.part == p] for p in sorted(sizes)]
    assert [k for part in by_part for k in part] == sorted(r.mix_key for r in rows)


def test_what_operators_write_can_be_removed(spark):
    import os

    from tessera.llm import _shared

    _shared.written(spark.range(3), "numbers").count()
    folder = _shared.run_dir(spark).removeprefix("file://")
    assert os.listdir(folder)
    _shared.remove_written(spark)
    assert not os.path.exists(folder)
    assert _shared.written(spark.range(3), "numbers").count() == 3
