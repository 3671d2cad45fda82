import random
import unicodedata
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_codec as codec


def direct(texts):
    tokenizer = Tokenizer.from_file(codec.tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=3000), st.integers(6, 12))
def test_round_trip_and_length_limit(ids, max_bits):
    ids = np.array(ids)
    counts = np.bincount(ids, minlength=64)
    lengths = codec.limited_lengths(counts, max_bits)
    assert lengths.max() <= max_bits
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    payload, offsets = codec.pack(ids, lengths, codec.canonical_codes(lengths))
    assert (codec.unpack([payload] * 2, [offsets] * 2, [len(ids)] * 2, codec.decode_table(lengths))[1] == ids).all()


def test_lengths_are_optimal():
    import heapq

    counts = np.array([2**i for i in range(12)] + [5, 7, 7, 100])
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert (counts * codec.limited_lengths(counts, 20)).sum() == cost
    assert (counts * codec.limited_lengths(counts, 5)).sum() > cost


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=100, deadline=None)
def test_chunks_encode_as_whole_texts(texts):
    encode = test_chunks_encode_as_whole_texts.__dict__.setdefault("f", codec.chunk_encoder(open(codec.tokenizer_path(), encoding="utf-8").read()))
    ids, bounds = encode(pa.array(texts, type=pa.string()))
    assert [[*ids[i:j].tolist(), 1] for i, j in zip(bounds, bounds[1:], strict=False)] == direct(texts)


def test_query_equals_direct_encoding(spark):
    rows = {r.doc_id: r for r in codec.query(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    start = 0
    for i, ids in zip(sorted(texts), direct([texts[i] for i in sorted(texts)]), strict=True):
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_read_gives_the_ids(spark, tmp_path):
    frame = spark.createDataFrame([(2, "some words"), (1, "more, and MORE")], "doc_id long, text string")
    codec.write(frame, f"file://{tmp_path}/files", codec.tokenizer_path())
    rows = codec.read(spark, f"file://{tmp_path}/files").orderBy("start").collect()
    assert [np.frombuffer(r.ids, dtype="<u4").tolist() for r in rows] == direct(["more, and MORE", "some words"])
    assert [crc(np.frombuffer(r.ids, dtype="<u4")) for r in rows] == [r.ids_crc32 for r in rows]


@pytest.mark.parametrize("memo", [3, 200_000])
def test_edge_rows(spark, memo, monkeypatch):
    monkeypatch.setattr(codec, "MEMO", memo)
    long = "abc Δέλτα 12's " * 40_000
    data = [(9, "b"), (2, None), (5, ""), (None, "first"), (5, ""), (3, long), (2, "<|endoftext|> x")]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("part", F.lit("p"))
    rows = codec.digest(frame, codec.tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 2, 2, 3, 5, 5, 9]
    assert [r.start for r in rows] == [0, *accumulate(r.n_tokens for r in rows)][:-1]
    want = sorted((i is not None, i or 0, len(x), crc(x)) for (i, _), x in zip(data, direct([t for _, t in data]), strict=True))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert codec.digest(frame.limit(0), codec.tokenizer_path()).count() == 0


def test_every_code_point_beside_a_sign():
    encode = codec.chunk_encoder(open(codec.tokenizer_path(), encoding="utf-8").read())
    tokenizer = Tokenizer.from_file(codec.tokenizer_path())
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or chr(c).isalnum() or unicodedata.combining(chr(c)))]
    signs = codec.TAIL
    for at in range(0, len(letters), 20_000):
        part = letters[at : at + 20_000]
        texts = [f"{c}{signs[i % len(signs)]} {signs[(i + 5) % len(signs)]}{c} a{c}{signs[(i + 9) % len(signs)]} {c}a{signs[(i + 2) % len(signs)]}" for i, c in enumerate(part, at)]
        ids, bounds = encode(pa.array(texts))
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == want
    twice = [c for c in letters if len(unicodedata.normalize("NFC", c.lower())) > 1]
    texts = [c + s for c in twice for s in signs]
    ids, bounds = encode(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    rng = random.Random(1)
    pool = "abcXYZ019 \n\t" + signs + "'éİßΣΔ中文१ी’“—̸́ ​" + "".join(twice)
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 24))) for _ in range(100_000)]
    ids, bounds = encode(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_repeated_ids_are_split_over_parts(spark):
    frame = spark.range(3000).selectExpr("cast(if(id % 3 = 0, id, null) as long) doc_id", "if(id % 2 = 0, 'same words', concat('word ', id)) text").repartition(4)
    path = f"file://{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/hot-ids"
    codec.write(frame, path, codec.tokenizer_path())
    parts = spark.read.parquet(f"{path}/blocks").selectExpr("part", "size(doc_ids) n").groupBy("part").sum("n").collect()
    assert len(parts) >= 3 and max(r[1] for r in parts) < 1800
