"""Operator 5, token ids as length-limited canonical Huffman blocks.

Three passes over the data, each a plain Spark stage:

1. Every text is encoded to ids once; ids go to the shared folder as two or four bytes each.
2. Global counts of ids (at most one row per id of the vocabulary) give the code lengths by
   package-merge; codes are canonical, so the file keeps the lengths only.
3. Documents are range-partitioned by doc_id and packed in that order into blocks of about
   ``BLOCK_TOKENS`` ids. A block is one row of a Parquet folder: the bit string, the bit offset
   of every ``STRIDE``-th id, and the doc_ids and lengths. Blocks and strides decode alone, with
   one table look-up per id.

Words repeat, so ids of a blank-separated chunk are kept per worker in a bounded memo; chunks
encode alone as this tokenizer drops white space and never merges across it.

Nulls: a null text counts as empty, which gives the end id only. A null doc_id sorts first.
Rows of one doc_id are ordered by the crc32 of their ids, and repeated rows by the task that
encoded them, so a doc_id that repeats may span partitions. Other columns are not read, whatever
their names. An empty table gives no rows. A document may be of any length; a block holds one at
least.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, partitions, run_dir, table, written

END_ID = 1
MAX_BITS = 20
BLOCK_TOKENS = 1 << 16
STRIDE = 512
#: Chunks of text whose ids a worker keeps, in each of two generations.
MEMO = 400_000
#: Bytes of text that are encoded together.
TOGETHER = 8 << 20
#: Signs that are cut off the end of a chunk after an ASCII letter or digit, and encoded by themselves.
#: Other letters may decompose and leave a mark that belongs to the signs.
TAIL = ".,;:!?|$%&*#)"


def chunk_encoder(tokenizer_json: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from an array of texts to all their ids and each text's first and last place, equal to encoding each whole text.

    Holds for tokenizers that drop white space and split at it before merging.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    wide = tokenizer.get_vocab_size() > 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")
    lower = '"Lowercase"' in tokenizer_json
    merge = tokenizer.model.tokenize
    memos: list[dict[str, bytes]] = [{}, {}]

    def learn_words(words: list[str], memo: dict[str, bytes]) -> None:
        """Words of lower-case ASCII letters: the other steps of the tokenizer leave them as they are, so only its merges are run."""
        found = [[t.id for t in merge(w)] for w in words]
        raw = np.fromiter(chain.from_iterable(found), dtype=kind).tobytes()
        cut = list(accumulate((len(x) * kind.itemsize for x in found), initial=0))
        memo.update(zip(words, map(raw.__getitem__, map(slice, cut, cut[1:])), strict=True))

    def learn(chunks: list[str], memo: dict[str, bytes]) -> None:
        for at in range(0, len(chunks), 500):
            part = chunks[at : at + 500]
            found = tokenizer.encode(" ".join(part), add_special_tokens=False)
            begin = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            raw = np.array(found.ids, dtype=kind).tobytes()
            cut = (np.searchsorted(begin, np.cumsum([0, *map(len, part)]) + np.arange(len(part) + 1)) * kind.itemsize).tolist()
            memo.update(zip(part, map(raw.__getitem__, map(slice, cut, cut[1:])), strict=True))

    def look_up(chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks. A new one is learned without the signs at its end, which are learned once."""
        young, old = memos
        found = list(map(young.get, chunks))
        if missing := [i for i, x in enumerate(found) if x is None]:
            new = [chunks[i] for i in missing]
            young.update((c, old[c]) for c in new if c in old)
            new = [c for c in new if c not in young]
            ends = {c: core for c in new if (core := c.rstrip(TAIL)) != c and core and core[-1].isascii() and core[-1].isalnum()}
            parts = {*ends.values(), *(c[len(core) :] for c, core in ends.items()), *(c for c in new if c not in ends)}
            parts = [c for c in parts if c not in young]
            learn_words(words := [c for c in parts if c.isascii() and c.isalpha() and c.islower()], young)
            learn(list({*parts}.difference(words)), young)
            young.update((c, young[core] + young[c[len(core) :]]) for c, core in ends.items())
            for i in missing:
                found[i] = young[chunks[i]]
        if len(young) > MEMO:
            memos[:] = [{}, young]
        return found

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Upper-case A to Z is folded first where the tokenizer does it and no special token can be in a text."""
        texts = pc.fill_null(texts, "")
        if lower and not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.cast(pc.ascii_lower(texts), pa.string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ").cast(pa.large_list(pa.string()))
        chunks = split.flatten().dictionary_encode()
        known = pa.array(look_up(chunks.dictionary.to_pylist()), type=pa.large_binary())
        taken = known.take(chunks.indices)
        _, ends, data = taken.buffers()
        at = np.frombuffer(ends, dtype=np.int64)[taken.offset :]
        bounds = at[split.offsets.to_numpy() - split.offsets[0].as_py()] // kind.itemsize
        return np.frombuffer(data or b"", dtype=kind), bounds

    return encode


def limited_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code lengths of an optimal prefix code of at most max_bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged: list[np.ndarray] = []  # of each level: which entries are leaves, in order of weight
    packages = np.array([])
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        merged.append(at < len(leaves))
        both = both[at]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * (len(leaves) - 1)
    depth = np.zeros(len(leaves), dtype=np.uint8)
    for level in reversed(merged):
        n = int(level[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code = before = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.count_nonzero(lengths == 0) :]:
        code <<= int(lengths[i]) - before
        codes[i], before = code, int(lengths[i])
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) by the next ``width`` bits, and that width."""
    width = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.count_nonzero(lengths == 0) :]
    spans = (1 << (width - lengths[order].astype(np.int64)))
    ids = np.zeros(1 << width, dtype=np.uint32)
    sizes = np.ones(1 << width, dtype=np.uint8)
    filled = int(spans.sum())
    ids[:filled] = np.repeat(order, spans)
    sizes[:filled] = np.repeat(lengths[order], spans)
    return ids, sizes, width


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ids, and the bit offset of every STRIDE-th of them.

    Codes that begin in one 64-bit word are shifted into place and added; what runs over goes to the next word.
    """
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(-(-total // 64) + 1, dtype=np.uint64)
    if total:
        code, at = codes[ids].astype(np.uint64), starts >> 6
        over = (starts & 63) + size - 64  # bits in the next word
        left = code << np.maximum(-over, 0).astype(np.uint64)
        crossing = np.flatnonzero(over > 0)
        part = over[crossing].astype(np.uint64)
        left[crossing] = code[crossing] >> part
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[first]] = np.add.reduceat(left, first)
        words[at[crossing] + 1] += code[crossing] << (np.uint64(64) - part)
    return words.astype(">u8").tobytes()[: -(-total // 8)], starts[::STRIDE]


def unpack(payloads: list[bytes], offsets: list[np.ndarray], counts: list[int], table_: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    """The ids of several blocks; all strides of all blocks advance together, an id at a time."""
    if not payloads:
        return []
    ids, sizes, width = table_
    base = np.cumsum([0, *(len(p) for p in payloads)])
    data = b"".join(payloads) + b"\0" * 8
    words = np.ndarray((len(data) - 3,), dtype=">u4", buffer=data, strides=(1,))  # four bytes from each byte on
    at = np.concatenate([o + 8 * b for o, b in zip(offsets, base, strict=False)])
    left = np.concatenate([np.minimum(STRIDE, n - np.arange(0, n, STRIDE)) for n in counts])
    live = np.argsort(-left, kind="stable")
    at, ordered = at[live], left[live]
    out = np.zeros((STRIDE, len(at)), dtype=np.uint32)
    for step in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-ordered, -step, side="left"))  # strides that have more than step ids
        here = at[:n]
        word = words[here >> 3].astype(np.uint32)
        slot = (word << (here & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[step, :n] = ids[slot]
        here += sizes[slot]
    back = np.empty_like(live)
    back[live] = np.arange(len(live))
    rows = out.T[back]
    found, row = [], 0
    for n in counts:
        found.append(rows[row : row + -(-n // STRIDE)].reshape(-1)[:n])
        row += -(-n // STRIDE)
    return found


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to about TOGETHER bytes; one text may be longer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= TOGETHER:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _ids(documents: DataFrame, id_col: str, text_col: str, tokenizer_json: str, end_id: int) -> DataFrame:
    broadcast = documents.sparkSession.sparkContext.broadcast(tokenizer_json)  # one tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, salt = chunk_encoder(broadcast.value), TaskContext.get().partitionId()
        for batch in _together(batches):
            ids, bounds = encode(batch.column(1))
            end = ids.dtype.type(end_id).tobytes()
            ended = [ids[i:j].tobytes() + end for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            columns = [batch.column(0), pa.array(ended, type=pa.binary()), pa.array(map(zlib.crc32, ended), type=pa.int64()), pa.array(np.full(len(ended), salt, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "crc", "salt"])

    return documents.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, crc long, salt int")


def _counts(ids: DataFrame, vocab: int, kind: str) -> np.ndarray:
    """Global counts; the driver gets at most one row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind), minlength=vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "c"])

    counts = np.zeros(vocab, dtype=np.int64)
    for row in ids.select("ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        counts[row.id] = row.c
    return counts


def write(documents: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, max_bits: int = MAX_BITS) -> None:
    """Encode and write ``path/blocks``, ``path/lengths`` (the code) and ``path/parts`` (ids of each part)."""
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    vocab = 1 + max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    kind = "<u4" if vocab > 1 << 16 else "<u2"
    ids = written(_ids(documents, id_col, text_col, text, end_id), "ids")
    lengths = limited_lengths(_counts(ids, vocab, kind), max_bits)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/lengths")
    code = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # vocabulary-sized

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, size = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []

        def block() -> pa.RecordBatch:
            payload, offsets = pack(np.concatenate(held), *code.value)
            names = ["part", "start", "doc_ids", "sizes", "offsets", "payload"]
            values = [[part], [start], [docs], [[len(x) for x in held]], [offsets.tolist()], [payload]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                held.append(np.frombuffer(x.as_py(), dtype=kind))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    start, held, docs, size = start + size, [], [], 0
        if docs:
            yield block()

    order = ["doc_id", "crc", "salt"]
    ordered = ids.select("doc_id", "ids", "crc", "salt").repartitionByRange(partitions(ids), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(run, "part int, start long, doc_ids array<long>, sizes array<long>, offsets array<long>, payload binary").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    found = sorted((r.part, r.n) for r in parts.collect())  # one row per partition
    before = np.cumsum([0, *(n for _, n in found)])
    spark.createDataFrame([(p, int(b)) for (p, _), b in zip(found, before, strict=False)], "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode the files: ``(doc_id, start, n_tokens, ids_crc32, ids)`` per document; start counts ids of all documents before it.

    ids: little-endian unsigned 32-bit integers, left out without with_ids; ids_crc32 is taken of them.
    """
    code = spark.read.parquet(f"{path}/lengths").collect()
    lengths = np.zeros(1 + max((r.id for r in code), default=0), dtype=np.uint8)
    for r in code:
        lengths[r.id] = r.bits
    before = {r.part: r.before for r in spark.read.parquet(f"{path}/parts").collect()}
    shared = spark.sparkContext.broadcast((lengths, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, before = shared.value
        look_up = decode_table(lengths)
        for batch in batches:
            columns = batch.to_pydict()
            for at in range(0, batch.num_rows, 16):
                part = {k: v[at : at + 16] for k, v in columns.items()}
                found = unpack(part["payload"], [np.array(o, dtype=np.int64) for o in part["offsets"]], [sum(s) for s in part["sizes"]], look_up)
                docs, starts, sizes, raw, crcs = [], [], [], [], []
                for i, ids in enumerate(found):
                    ends = np.cumsum(part["sizes"][i])
                    first = before[part["part"][i]] + part["start"][i]
                    docs += part["doc_ids"][i]
                    sizes += part["sizes"][i]
                    starts += [first + int(e) - n for e, n in zip(ends, part["sizes"][i], strict=True)]
                    own = [ids[e - n : e].astype("<u4", copy=False) for e, n in zip(ends, part["sizes"][i], strict=True)]
                    crcs += map(zlib.crc32, own)
                    raw += [x.tobytes() for x in own] if with_ids else []
                made = [pa.array(x, type=pa.int64()) for x in (docs, starts, sizes, crcs)] + [pa.array(raw, type=pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(made)])

    blocks = spark.read.parquet(f"{path}/blocks")
    return blocks.select("part", "start", "doc_ids", "sizes", "offsets", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def digest(documents: DataFrame, tokenizer_path: str, **columns: str) -> DataFrame:
    """Write documents to a new folder of the shared one, read it back: ``(doc_id, start, n_tokens, ids_crc32)``."""
    spark = documents.sparkSession
    path = f"{run_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(documents, path, tokenizer_path, **columns)
    return read(spark, path, with_ids=False)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), tokenizer_path())
