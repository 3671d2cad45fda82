"""Operator 9, SimHash near-dedup by a binary trie self-join.

Fingerprints are 64 bits; two link when at most ``budget`` bits differ. The 64 bits are cut
into ``budget + 1`` blocks. Two linked fingerprints agree in at least one block, so each
fingerprint goes to ``budget + 1`` tries, one per block, keyed by the value of that block and
holding the bits rotated so that the block comes first. A task gets whole tries. It walks
pairs of nodes of the same trie together, adds up the bits in which their paths differ and
drops a pair of nodes as soon as the budget is exceeded. A trie with more than
``bucket_rows`` fingerprints is cut again the same way: its bits after the shared ones are
cut into ``budget + 1`` blocks and each of its rows goes to as many smaller tries, until none
is larger. At four bits a row is held 5 times, and in tries past a million rows 25 times, with
23 bits in common; no trie of a task is larger than bucket_rows.

Copies fall together before the join (a trie holds distinct fingerprints) and a task reports a
spanning forest of what it linked, never all pairs of a group. A fingerprint of more than a
thousandth of all rows is dealt out by a salt when rows get their component.

Nulls: a null text counts as empty. A text without words has fingerprint zero, linked like any
other. A null doc_id gets a component as well and is never its id unless all are null (then
null). Repeated rows stay. Texts of any length are read whole; a task holds the words of one text.
Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, keep_rows, partitions, table, written
from tessera.llm.components import connected_components

#: A fingerprint of more than this share of all rows, and this many, is salted into so many parts.
HOT_SHARE, HOT_ROWS, SALTS = 0.001, 10_000, 64
#: Pairs of ranges with at most this product of sizes are compared directly.
SMALL = 32
#: Pairs of nodes handled at once.
FRONTIER = 1 << 18


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text: bit i is set if it is set in over half the shingles' hashes."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, seed) for s in shingles], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(doc_id, fp, text_hash)`` of every row; fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    read = documents.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"), F.xxhash64(column(text_col)).alias("text_hash"))
    return read.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _blocks(budget: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each of the budget + 1 blocks of so many bits."""
    n = budget + 1
    widths = [bits // n + (i < bits % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _expand(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's index repeated ``size`` times, and the running position in its range."""
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return owner, lo[owner] + inside


class _Forest:
    """Components of the rows of a chunk, as flat labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.run = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        a, b = label[a], label[b]
        keep = a != b
        if not keep.any():
            return
        a, b = a[keep], b[keep]
        root = np.arange(len(label))
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, ra, rb)
            np.minimum.at(root, rb, ra)
            while (root[root] != root).any():
                root = root[root]
        self.label = root[label]
        self.run = np.cumsum(np.concatenate([[0], self.label[1:] != self.label[:-1]]))

    def joined(self, a_lo, a_hi, b_lo, b_hi) -> np.ndarray:
        """Where all rows of both ranges are in one component already."""
        run, label = self.run, self.label
        return (run[a_lo] == run[a_hi - 1]) & (run[b_lo] == run[b_hi - 1]) & (label[a_lo] == label[b_lo])


def trie_links(bits: np.ndarray, starts: list[np.ndarray], budget: int, depth: int = 0) -> np.ndarray:
    """Walk pairs of trie nodes together; a label per row, equal where rows are linked.

    bits: rows as unsigned 64-bit path bits, each range of ``starts`` sorted. starts: arrays
    a_lo, a_hi, b_lo, b_hi of the pairs of ranges to begin with; a range shares its first
    ``depth`` bits.
    """
    forest = _Forest(len(bits))
    near = np.arange(len(bits) - 1)
    same = np.zeros(len(bits), dtype=np.int64)  # rows of one starting range have one number
    edges = np.unique(np.concatenate(starts)) if len(starts[0]) else np.array([], dtype=np.int64)
    same[edges[edges < len(bits)]] = 1
    same = np.cumsum(same)
    near = near[(same[1:] == same[:-1]) & (np.bitwise_count(bits[1:] ^ bits[:-1]) <= budget)] if len(bits) > 1 else near[:0]
    forest.link(near, near + 1)
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, [np.asarray(x, dtype=np.int64) for x in starts], np.zeros(len(starts[0]), dtype=np.int64))]
    while stack:
        level, (a_lo, a_hi, b_lo, b_hi), diff = stack.pop()
        if len(a_lo) > FRONTIER:
            order = np.argsort(-diff, kind="stable")  # fewest differences last, so first off the stack
            for at in range(0, len(order), FRONTIER):
                part = order[at : at + FRONTIER]
                stack.append((level, [x[part] for x in (a_lo, a_hi, b_lo, b_hi)], diff[part]))
            continue
        keep = ~forest.joined(a_lo, a_hi, b_lo, b_hi)
        small = keep & (((a_hi - a_lo) * (b_hi - b_lo) <= SMALL) | (level >= 64))
        if small.any():
            s = np.flatnonzero(small)
            owner, left = _expand(a_lo[s], a_hi[s] - a_lo[s])
            again, right = _expand(b_lo[s][owner], (b_hi - b_lo)[s][owner])
            left = left[again]
            hit = (left != right) & (np.bitwise_count(bits[left] ^ bits[right]) <= budget)
            forest.link(left[hit], right[hit])
        keep &= ~small
        if level >= 64 or not keep.any():
            continue
        a_lo, a_hi, b_lo, b_hi, diff = (x[keep] for x in (a_lo, a_hi, b_lo, b_hi, diff))
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((bits >> np.uint64(63 - level)) & np.uint64(1))]).astype(np.int64)
        count = ones[level]
        a_mid, b_mid = a_hi - (count[a_hi] - count[a_lo]), b_hi - (count[b_hi] - count[b_lo])
        own = a_lo == b_lo
        child = [
            (a_lo, a_mid, b_lo, b_mid, diff, np.ones_like(own)),
            (a_mid, a_hi, b_mid, b_hi, diff, np.ones_like(own)),
            (a_lo, a_mid, b_mid, b_hi, diff + 1, np.ones_like(own)),
            (a_mid, a_hi, b_lo, b_mid, diff + 1, ~own),  # of a node with itself the mirror image
        ]
        parts = [np.concatenate([c[i] for c in child]) for i in range(6)]
        good = parts[5] & (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= budget)
        good &= ~((parts[0] == parts[2]) & (parts[1] - parts[0] < 2))
        if good.any():
            stack.append((level + 1, [x[good] for x in parts[:4]], parts[4][good]))
    return forest.label


def _chunk_links(path: np.ndarray, prefix: np.ndarray, bits: np.ndarray, fp: np.ndarray, budget: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning links (fp, fp of its root) of complete tries, whose rows share their first ``depth`` bits."""
    order = np.lexsort((bits, prefix, path))
    path, prefix, bits, fp = (x[order] for x in (path, prefix, bits, fp))
    group = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (prefix[1:] != prefix[:-1])]))
    ends = np.append(group[1:], len(path))
    label = trie_links(bits, [group, ends, group, ends], budget, depth)
    moved = label != np.arange(len(label))
    return fp[moved], fp[label[moved]]


def _cut(rows: DataFrame, budget: int) -> DataFrame:
    """``(fp, path, prefix, bits, used)``: each row once for each block of the bits after its first ``used``.

    The block is moved behind those; path numbers the blocks taken, prefix is their value.
    """
    found = None
    for used in sorted(r.used for r in rows.select("used").distinct().collect()):  # one or two widths a round
        rest = 64 - used
        low = F.lit(-1 if rest == 64 else (1 << rest) - 1).cast("long")
        kept, moving = F.col("bits").bitwiseAND(F.bitwise_not(low)), F.col("bits").bitwiseAND(low)
        each = []
        for i, (at, width) in enumerate(_blocks(budget, rest)):
            turned = moving if not at else F.shiftleft(moving, at).bitwiseOR(F.shiftrightunsigned(moving, rest - at)).bitwiseAND(low)
            bits = kept.bitwiseOR(turned)
            if width:
                each.append(F.struct((F.col("path") * (budget + 1) + i + 1).alias("path"), F.shiftrightunsigned(bits, rest - width).alias("prefix"), bits.alias("bits"), F.lit(used + width).alias("used")))
        part = rows.filter(F.col("used") == used).select("fp", F.explode(F.array(*each)).alias("t")).select("fp", "t.*")
        found = part if found is None else found.union(part)
    return found


def _tries(distinct: DataFrame, budget: int, bucket_rows: int) -> DataFrame:
    """``(path, prefix, bits, fp)``: the rows of every trie, none of more than bucket_rows."""
    rows = distinct.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("bits"), F.lit(0).alias("used"))
    if rows.isEmpty():
        return rows.select("path", F.col("bits").alias("prefix"), "bits", "fp")
    done = None
    while True:
        tries = _cut(rows, budget)
        large = tries.groupBy("path", "prefix", "used").count().filter((F.col("count") > bucket_rows) & (F.col("used") < 64)).select("path", "prefix")
        large = written(large, "simhash-large")
        whole = large.isEmpty()
        small = tries if whole else tries.join(large, ["path", "prefix"], "left_anti")
        part = small.select("path", "prefix", "bits", "fp")
        done = part if done is None else done.union(part)
        if whole:
            return done
        rows = written(tries.join(large, ["path", "prefix"], "left_semi").select("fp", "path", "bits", "used"), "simhash-cut")


def links(distinct: DataFrame, budget: int = 4, bucket_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints within the budget.

    Every pair within the budget is joined by a path of links; pairs of a group are not listed.
    A task holds the rows of one trie, at most bucket_rows, or chunk_rows of small ones.
    """
    depth = min(width for _, width in _blocks(budget))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def done(part: np.ndarray) -> pa.RecordBatch:
            a, b = _chunk_links(part[0], part[1], part[2].view(np.uint64), part[3], budget, depth)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            rows += batch.num_rows
            if rows >= chunk_rows:
                part = np.concatenate(held, axis=1)
                last = (part[0] != part[0, -1]) | (part[1] != part[1, -1])
                cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # the last trie may go on
                if cut:
                    yield done(part[:, :cut])
                held, rows = [part[:, cut:]], part.shape[1] - cut
        if rows:
            yield done(np.concatenate(held, axis=1))

    tries = _tries(distinct, budget, bucket_rows)
    return tries.repartition(partitions(distinct), "path", "prefix").sortWithinPartitions("path", "prefix").mapInArrow(run, "a long, b long")


def _groups(documents: DataFrame, id_col: str, text_col: str, words: int, budget: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every row, and ``(fp, least, n, label)`` of every distinct one; n: its rows, label: the least fp linked."""
    fps = written(fingerprints(documents, id_col, text_col, words), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    label = connected_components(links(distinct.select("fp"), budget, bucket_rows), "a", "b").select(F.col("node").alias("fp"), "label")
    return fps, distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, budget: int = 4, bucket_rows: int = 1_000_000) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row; component_id: the least doc_id linked, directly or not."""
    fps, grouped = _groups(documents, id_col, text_col, words, budget, bucket_rows)
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    found = grouped.join(least, "label").select("fp", "n", "component_id")
    often = F.col("n") > max(HOT_ROWS, HOT_SHARE * fps.count())
    hot = F.broadcast(grouped.filter(often).select("fp", F.lit(SALTS).alias("salts")))  # at most 1 / HOT_SHARE rows
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", F.spark_partition_id()), F.col("salts"))
    dealt = fps.join(hot, "fp", "left").select("doc_id", "fp", F.coalesce(salt, F.lit(0).cast("long")).alias("salt"))
    wide = found.select("fp", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.when(often, SALTS - 1).otherwise(0).cast("long"))).alias("salt"))
    return dealt.join(wide, ["fp", "salt"], "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, budget: int = 4, bucket_rows: int = 1_000_000) -> DataFrame:
    """One row of each component, all columns: that of the least doc_id (null last), then of the least text hash.

    Columns may have any names and types. Of rows with the same doc_id and text the least by a hash of all columns stays.
    """
    fps, grouped = _groups(documents, id_col, text_col, words, budget, bucket_rows)
    of_each = fps.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("r"))  # before the join, so that no fingerprint is hot in it
    first = of_each.join(grouped.select("fp", "label"), "fp").groupBy("label").agg(F.min("r").alias("r"))
    return keep_rows(documents, first.select("r.*"), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
