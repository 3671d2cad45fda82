"""Operator 8, language-model scoring by a weighted backoff automaton of word trigrams.

States are histories of no word, one or two words seen in training texts; a text begins in the
state of its start. A state has an arc for each word seen after it and a failure arc to the state
of one word less. With c(h) the count of a history and ``s`` the strength of its order,

    P(w | h) = (c(h w) + s P(w | shorter h)) / (c(h) + s),

so the arc of a word seen weighs log P(w | h), and the failure arc log(s / (c(h) + s)). Each state
is a distribution. The root discounts all counts alike and leaves what that frees to a single
unknown word, as the base does. One walk over a text from left to right carries the state, takes
its arc or falls, and adds up the logarithms.

All n-grams of all training texts are counted; nothing is cut off, so the automaton grows with the
corpus, and it is never in one place. Texts are made into blocks of about ``block_bytes`` once: word
numbers and the distinct words' 64-bit hashes. Each block sends its distinct n-grams, as sorted
hashes with their counts in training texts, to the buckets of their hash; a bucket adds up the
counts of all blocks and sends each block the totals of what it sent. That one exchange is the
counting and the join. Words have 64-bit keys; those of pairs and triples are as wide as the number
of tokens and 16 bits more, so one in 65,000 may share a count with another. A key comes once from a block, however often it occurs, so no bucket is hot;
there are as many buckets as keys need. The driver sees four numbers of each bucket of words.

Nulls: a null text counts as empty, which is the end token alone. A null doc_id is no held-out
row. Repeated rows are counted and scored each. Texts of any length are read whole; a longer one is
a block of its own. Other columns are not read, whatever their names. An empty table gives no rows;
without training rows every count is zero and the unknown word is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, partitions, table, written

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 8 << 20
#: Keys that a bucket gets from all blocks, about.
BUCKET_KEYS = 2_000_000
#: Buckets, or blocks, that a task gets at most on average, however few partitions the session asks for.
TOGETHER = 4
#: How much the shorter history counts, for histories of one and of two words.
STRENGTHS = (1000.0, 5.0)
#: Bits of a pair's or triple's key beyond those that number all tokens.
SPARE = 16
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and how many each text has."""
    lower = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    split = pc.ascii_split_whitespace(lower)
    words, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)  # none at a text's ends
    sizes = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(lower))
    return words.filter(real).cast(pa.large_binary()), sizes


def held_out(id_col: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two 64-bit numbers."""
    x = a * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Block:
    """The texts of a row of ``blocks``, and the keys of their n-grams."""

    def __init__(self, row: dict):
        self.docs, self.held, self.sizes = row["doc_ids"], np.array(row["held"], dtype=bool), np.array(row["sizes"], dtype=np.int64)
        words = np.append(np.frombuffer(row["words"], dtype="<u8"), END)
        ends = np.cumsum(self.sizes + 1) - 1  # where each text's end stands
        self.firsts = ends - self.sizes
        codes = np.full(len(self.sizes) + int(self.sizes.sum()), len(words) - 1, dtype=np.int32)
        inside = np.ones(len(codes), dtype=bool)
        inside[ends] = False
        codes[inside] = from_planes(row["codes"])
        self.read = words[codes]
        self.first = np.zeros(len(codes), dtype=bool)
        self.first[self.firsts] = True

    def keys(self) -> Iterator[np.ndarray]:
        """Of words, pairs and triples: a key for each place; triples have none at a text's first place."""
        yield self.read
        before = np.concatenate([[START], self.read[:-1]]).astype(np.uint64)
        before[self.firsts] = START
        pairs = mixed(before, self.read)
        yield pairs
        rest = np.flatnonzero(~self.first)
        yield mixed(pairs[rest - 1], self.read[rest])

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes + 1)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, doc_ids, held, sizes, words, codes, n_tokens, n_words)``: texts as word numbers, words as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33

        def made(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            words, sizes = words_in(rows["text"].combine_chunks())
            coded = words.dictionary_encode()
            hashes = np.array(list(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist())), dtype="<u8")
            codes = coded.indices.to_numpy()
            number += 1
            values = [number, rows["doc_id"].to_pylist(), rows["held"].to_pylist(), sizes.tolist(), hashes.tobytes(), planes(codes), len(codes) + len(sizes), len(hashes) + 1]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(values, kinds, strict=True)], names=["block", "doc_ids", "held", "sizes", "words", "codes", "n_tokens", "n_words"])

        held, size = [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
            begin = 0
            for i, n in enumerate(lengths.tolist(), 1):
                size += n + 1
                if size >= block_bytes:
                    held.append(batch.slice(begin, i - begin))
                    yield made(pa.Table.from_batches(held))
                    begin, held, size = i, [], 0
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield made(pa.Table.from_batches(held))

    schema = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, words binary, codes binary, n_tokens long, n_words long"
    return docs.select("doc_id", "held", "text").mapInArrow(run, schema)


def planes(numbers: np.ndarray) -> bytes:
    """Whole numbers, first all their low bytes, and so on up to the high ones, compressed."""
    n = np.ascontiguousarray(numbers, dtype="<u8")
    raw = n.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(n).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def from_planes(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    found = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=8 * n + 1), dtype=np.uint8)
    return np.ascontiguousarray(found.reshape(8, n).T).view("<u8").ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys, as their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw), dtype=np.uint64)


class Layout:
    """How keys of words, pairs and triples are cut: their bits, and how many of those number the buckets.

    Words keep 64 bits. Of pairs and triples, of which there are at most ``tokens`` each, ``SPARE`` bits more than tokens has are
    kept, so two of them share a key with a chance of 2^-SPARE at most.
    """

    def __init__(self, words: int, tokens: int, bucket_keys: int):
        wide = min(64, tokens.bit_length() + SPARE)
        self.width = (64, wide, wide)
        self.bits = tuple(max(0, (n // bucket_keys).bit_length()) for n in (words, tokens, tokens))

    def cut(self, order: int, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.width[order]) if self.width[order] < 64 else keys

    def bucket(self, order: int, keys: np.ndarray) -> np.ndarray:
        bits = self.bits[order]
        return keys >> np.uint64(self.width[order] - bits) if bits else np.zeros(len(keys), dtype=np.uint64)


def _asks(found: DataFrame, layout: Layout) -> DataFrame:
    """``(block, bucket, keys, counts)``: a block's distinct n-grams by bucket, with their counts in its training texts.

    bucket: the order in the bits from 40 up, then the first bits of the key, so a block's buckets are ranges of its sorted keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                training = block.training()
                for order, keys in enumerate(block.keys()):
                    distinct, at = np.unique(layout.cut(order, keys), return_inverse=True)
                    counts = np.bincount(at, training if order < 2 else training[~block.first], len(distinct)).astype(np.int64)
                    number = layout.bucket(order, distinct)
                    begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(distinct) else np.array([], dtype=np.int64)
                    rows = [(row["block"], order << 40 | int(number[a]), packed(distinct[a:b]), planes(counts[a:b])) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(distinct)], strict=False)]
                    for i in range(0, len(rows), 64):
                        columns = zip(*rows[i : i + 64], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "bucket", "keys", "counts"])

    return found.select("block", "doc_ids", "held", "sizes", "words", "codes").mapInArrow(run, "block long, bucket long, keys binary, counts binary")


def _answers(asks: DataFrame) -> DataFrame:
    """``(block, bucket, counts)``: the totals of the keys asked for; and of each bucket of words, with a null block, its statistics."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        each = [unpacked(x.as_py()) for x in group["keys"]]
        counts = np.concatenate([from_planes(x.as_py()) for x in group["counts"]])
        cut = np.cumsum([0, *map(len, each)])
        distinct, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, counts, len(distinct)).astype(np.int64)
        blocks_, out = group["block"].to_pylist(), [planes(total[at[a:b]]) for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
        if not bucket >> 40:
            stats = [total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum(), total[distinct == END].sum()]
            blocks_, out = [*blocks_, None], [*out, np.array(stats, dtype="<i8").tobytes()]
        return pa.table([pa.array(blocks_, type=pa.int64()), pa.array([bucket] * len(out), type=pa.int64()), pa.array(out, type=pa.binary())], names=["block", "bucket", "counts"])

    return asks.groupBy("bucket").applyInArrow(run, "block long, bucket long, counts binary")


class Corpus:
    """What the walk needs to know of all training texts: tokens, distinct ones, those seen once and twice, texts."""

    def __init__(self, tokens: int, distinct: int, once: int, twice: int, texts: int):
        self.tokens, self.distinct, self.texts = tokens, distinct, texts
        self.discount = once / (once + 2 * twice) if once and twice else 0.5

    def root(self, count: np.ndarray) -> np.ndarray:
        """The logarithm of a word's probability in the root, by its count."""
        if not self.tokens:
            return np.zeros(len(count))
        return np.log10(np.where(count > 0, np.maximum(count, 1) - self.discount, self.discount * self.distinct) / self.tokens)


def arcs(history: np.ndarray, count: np.ndarray, fallen: np.ndarray, strength: float) -> np.ndarray:
    """The logarithm of each word's probability in a state of that count: its arc, or the failure arc and what follows."""
    failure = np.log10(strength / (history + strength))
    arc = np.log10((count + strength * 10.0**fallen) / (history + strength))
    return np.where(count > 0, arc, failure + fallen)


def walk(block: Block, counts: list[np.ndarray], corpus: Corpus, strengths: tuple[float, float] = STRENGTHS) -> np.ndarray:
    """The log-probability of each token. counts: of the word, pair and triple that end at each place (0 for triples at first places).

    The count of the state carried into a place is that of the pair, or word, that ended at the place before.
    """
    word, pair, triple = counts
    one = np.concatenate([[0], word[:-1]])
    one[block.firsts] = corpus.texts
    two = np.concatenate([[0], pair[:-1]])
    two[block.firsts] = 0  # no state of two words yet: its failure arc weighs nothing
    return arcs(two, triple, arcs(one, pair, corpus.root(word), strengths[0]), strengths[1])


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS, strengths: tuple[float, float] = STRENGTHS, folds: int = FOLDS, fold: int = HELD_OUT) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    base_score: add-one unigrams. score: the automaton. Both are sums of log10 over words and end.
    """
    spark = documents.sparkSession
    docs = documents.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    docs = docs.withColumn("held", held_out("doc_id", folds, fold))
    found = written(blocks(docs, block_bytes), "lm-blocks")
    tokens, words, n_blocks = found.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    layout = Layout(words, tokens, bucket_keys)
    parts = lambda n: max(partitions(documents), -(-n // TOGETHER))  # noqa: E731  # so many groups, or blocks, are a task's share
    asks = _asks(found, layout).repartition(parts(sum(1 << b for b in layout.bits)), "bucket")
    answers = written(_answers(asks), "lm-counts")
    stats = answers.filter("block is null").select("counts").collect()  # a row for each bucket of words
    shared = spark.sparkContext.broadcast(Corpus(*np.sum([np.frombuffer(r.counts, dtype="<i8") for r in stats] or [[0] * 5], axis=0).tolist()))

    def run(state: pa.Table, told: pa.Table) -> pa.Table:
        corpus, rows = shared.value, []
        order = np.argsort(told["bucket"].to_numpy())
        buckets = told["bucket"].to_numpy()[order] >> 40
        found = [from_planes(told["counts"][int(i)].as_py()).astype(np.int64) for i in order]
        for row in state.to_pylist():
            block = Block(row)
            counts = []
            for n, keys in enumerate(block.keys()):
                total = np.concatenate([np.array([], dtype=np.int64), *(x for x, b in zip(found, buckets, strict=True) if b == n)])
                counts.append(total[np.unique(layout.cut(n, keys), return_inverse=True)[1]])
            triple = np.zeros(len(block.read), dtype=np.int64)
            triple[~block.first] = counts[2]
            per_text = lambda x, block=block: np.add.reduceat(x, block.firsts)
            base = np.log10((counts[0] + 1) / (corpus.tokens + corpus.distinct + 1))
            rows.append([block.docs, block.held, block.sizes + 1, per_text((counts[0] > 0).astype(np.int64)), np.full(len(block.docs), corpus.tokens), per_text(base), per_text(walk(block, [*counts[:2], triple], corpus, strengths))])
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([pa.array([v for r in rows for v in r[i]], type=k) for i, k in enumerate(kinds)], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    dealt = parts(n_blocks)
    states = found.select("block", "doc_ids", "held", "sizes", "words", "codes").repartition(dealt, "block")
    told = answers.filter("block is not null").repartition(dealt, "block")
    return states.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
