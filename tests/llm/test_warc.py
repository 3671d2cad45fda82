import hashlib
import io
import random

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import warc
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def brute(rows):
    """The contract, a row at a time: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    data = [(i, (html or "").encode()) for i, _, html in rows]
    groups, out = {}, []
    for i, p in data:
        groups.setdefault(p, []).append(i)
    for p, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            again = n > 0 and len(p) >= 100
            out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(map(str, out))


def got(frame):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in frame.collect())


def test_query_equals_sql(spark):
    assert oracle.rows(warc.query(spark, FOLDER).toPandas()) == oracle.rows(oracle.database(FOLDER).execute(warc.SQL).df())


class Kept(io.BytesIO):
    def close(self):
        pass


def test_seek_table_finds_each_frame():
    sink, rng = Kept(), random.Random(1)
    held = [rng.randbytes(rng.choice([0, 1, 50, 700])) for _ in range(200)]
    bundle = warc.BundleWriter(sink, 1000)
    places = [bundle.add(x) for x in held]
    bundle.close()
    data = sink.getvalue()
    reader = warc.BundleReader(pa.BufferReader(data))
    assert len(reader.frames) > 20 and max(raw for _, raw in reader.frames) <= 1000
    for (frame, at), x in zip(places, held, strict=True):
        assert reader.frame(frame)[at : at + len(x)] == x
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(held)  # any reader of Zstandard skips the seek table


def test_damage_is_seen():
    sink = pa.BufferOutputStream()
    bundle = warc.BundleWriter(sink)
    bundle.add(b"some bytes" * 100)
    bundle.close()
    with pytest.raises(ValueError, match="no seek table"):
        warc.BundleReader(pa.BufferReader(b"0" * 100))


def pages(spark):
    long, other = "<p>" + "x" * 200, "é" * 50  # 100 bytes
    rows = [(5, "http://a/5", long), (3, "http://a/3", long), (3, "http://a/3", long), (None, None, long), (9, "http://a b\r\nX: y/%41", other), (8, "http://a/8", other)]
    rows += [(1, "u", None), (2, "u", ""), (None, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "http://a/7", "<html>" * 300_000), (10, "", "y" * 99), (11, None, "y" * 99)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_edge_rows(spark):
    rows, frame = pages(spark)
    clash = frame.withColumn("row", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("size", F.lit(None).cast("int")).withColumn("first_row", F.lit(0)).repartition(3)
    assert got(warc.digest(clash)) == brute(rows)
    assert warc.digest(frame.limit(0)).count() == 0
    odd = frame.select(F.concat(F.lit("id\n%:"), F.col("page_id")).alias("my.id"), "url", "html")
    texts = warc.digest(odd, "my.id").collect()
    assert sorted(str(r.page_id) for r in texts) == sorted("None" if i is None else f"id\n%:{i}" for i, _, _ in rows)


def test_repeated_digests_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    rows, frame = pages(spark)
    assert got(warc.digest(frame)) == brute(rows)


def test_records_are_found_by_their_place(spark):
    rows = [(i, f"http://h/{i}", f"page {i % 70} " * 40) for i in range(300)]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/warc-test-{random.randrange(1 << 60)}"
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), path, frame_bytes=4000, bundle_bytes=3000)
    every = {r.record_id: r for r in warc.read(spark, path).collect()}
    index = warc.index(spark, path).collect()
    assert set(every) == {r.record_id for r in index} and len(every) == 300
    assert len({r.bundle for r in index}) > 3 and max(r.frame for r in index) > 2
    wanted = [r.record_id for r in index if int(r.page_id) % 17 == 0]
    found = warc.find(spark, path, spark.createDataFrame([(w,) for w in [*wanted, wanted[0], "urn:none"]], "record_id string")).collect()
    assert sorted(r.record_id for r in found) == sorted(wanted)
    for r in found:
        assert r == every[r.record_id]
        if r.record_type == "response":
            assert r.payload.decode() == rows[int(r.page_id)][2] and r.url == f"http://h/{r.page_id}"
    for r in every.values():
        if r.record_type == "revisit":
            to = every[r.refers_to_id]
            assert (to.page_id, to.payload_digest, to.record_type) == (r.refers_to, r.payload_digest, "response") and r.payload is None


def test_leavings_of_lost_tasks_are_not_read(spark):
    import pathlib

    path = f"{spark.conf.get('spark.checkpoint.dir')}/warc-test-{random.randrange(1 << 60)}"
    warc.write(spark.createDataFrame([(1, "u", "text")], SCHEMA), path)
    (pathlib.Path(path.removeprefix("file://")) / "bundles" / "half.warc.zst").write_bytes(b"half a bundle")
    assert warc.read(spark, path).count() == 1
