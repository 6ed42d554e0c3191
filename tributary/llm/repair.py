"""Operator 10, token-id files by Re-Pair grammar compression (Larsson and Moffat, 1999).

Documents are encoded, each with its end id, and laid out in ascending order of doc_id. A shard holds whole documents of
`shard_ids` ids at most, or one longer document. Its frequent id pairs are replaced by nonterminals, again and again,
until no pair occurs `min_count` times without overlap; a round replaces all frequent pairs whose places do not overlap.
A shard is one binary block:

    header   8 x little-endian uint32: magic "RPG2", documents, first nonterminal, rules, symbols, bits of a symbol,
             bits of a length, documents without an id (they come first)
    doc ids  int64 for each document
    bounds   uint32 for each document and one more: where its ids begin in the shard
    rules    two symbols for each rule
    lengths  for each rule how many ids it expands to, in 16 or 32 bits
    body     the symbols, in 16 or 32 bits each

With the expansion lengths a reader finds the symbols that cover any id range by a prefix sum and expands only those.
Blocks are written through Spark as rows of Parquet files, so any store that Spark reaches will do.

Defined cases: a null text is empty; an empty document is its end id alone; a null doc_id comes first; rows with the
same doc_id follow each other; extra columns are left out; no rows give no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ranges
from .bpe import vocabulary, vocabulary_path
from .common import bounded_batches, give_back, shuffle_partitions, table, text_slices, written

MAGIC = b"RPG2"
END_ID = 2
SHARD_IDS = 1 << 17
MIN_COUNT = 4
#: Bytes of text that are encoded at once for shards.
SLICE_BYTES = 8 << 20
#: Slots of the table that counts pairs before they are sorted, and the multiplier of its hash.
_SLOTS = 1 << 17
_ODD = 0x1E3779B97F4A7C15


def _places(weight: np.ndarray) -> np.ndarray:
    """Places, no two adjacent, taken in the order of weight where they compete (0: no candidate), leftmost in runs of one weight."""
    chosen = []
    place = np.flatnonzero(weight)
    for _ in range(3):  # what local maxima leave free is offered again; the rest waits for the next round
        if not len(place):
            break
        w = weight[place]
        near = place[1:] == place[:-1] + 1
        left = np.concatenate([[0], np.where(near, w[:-1], 0)])
        right = np.concatenate([np.where(near, w[1:], 0), [0]])
        start = np.maximum.accumulate(np.where(w != left, np.arange(len(w)), 0))
        take = (w >= left) & (w >= right) & ((np.arange(len(w)) - start) % 2 == 0)
        got = place[take]
        got = got[np.concatenate([[True], got[1:] > got[:-1] + 1])] if len(got) else got
        chosen.append(got)
        free = np.ones(len(weight) + 2, bool)
        free[got] = free[got + 1] = free[got + 2] = False
        place = place[free[place + 1]]
    return np.sort(np.concatenate(chosen)) if chosen else place


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, rules (pairs), expansion lengths and the first nonterminal of a sequence of ids."""
    seq = ids.astype(np.int64)
    base = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    # places whose pair may yet be frequent: a pair once found rare stays so until a neighbour changes
    open_ = np.arange(max(0, len(seq) - 1))
    while len(open_):
        key = (seq[:-1] << 32) | seq[1:] if len(open_) == len(seq) - 1 else (seq[open_] << 32) | seq[open_ + 1]
        slot = ((key * _ODD) >> 40) & (_SLOTS - 1)
        maybe = np.bincount(slot, minlength=_SLOTS)[slot] >= min_count  # a slot holds a pair's count at least
        open_, key = open_[maybe], key[maybe]
        if not len(open_):
            break
        order = np.argsort(key)
        ordered = key[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        often = count >= min_count
        if not often.any():
            break
        number = np.cumsum(often) - 1
        pair = np.empty(len(key), np.int64)
        pair[order] = np.repeat(np.where(often, number, -1), count)
        open_, pair = open_[pair >= 0], pair[pair >= 0]
        keys, count = ordered[first[often]], count[often]
        # a pair's priority is its count, ties to the smaller key
        priority = np.empty(len(keys), np.int64)
        priority[np.lexsort((-keys, count))] = np.arange(1, len(keys) + 1)
        by_priority = np.empty(len(keys) + 1, np.int64)
        by_priority[priority] = np.arange(len(keys))
        weight = np.zeros(len(seq), np.int32)
        weight[open_] = priority[pair]
        at = _places(weight)
        found = by_priority[weight[at]]
        useful = np.bincount(found, minlength=len(keys)) >= min_count
        at, found = at[useful[found]], found[useful[found]]
        if not len(at):
            break
        pairs = np.stack([keys[useful] >> 32, keys[useful] & 0xFFFFFFFF], axis=1)
        size = np.where(pairs >= base, lengths[np.maximum(pairs - base, 0)] if len(lengths) else 1, 1)
        seq[at] = base + len(lengths) + (np.cumsum(useful) - 1)[found]
        rules.append(pairs)
        lengths = np.concatenate([lengths, size.sum(axis=1)])
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        fresh = np.zeros(len(seq), bool)
        fresh[open_] = fresh[at] = True
        fresh[at[at > 0] - 1] = True
        seq, fresh = seq[keep], fresh[keep]
        # the place before a merged one may have lost its right neighbour's old name: it is the last kept place before it
        merged = at - np.arange(len(at))
        fresh[merged[merged > 0] - 1] = True
        fresh[-1:] = False
        open_ = np.flatnonzero(fresh)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), lengths, base


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every rule, one after another, and where each begins. A rule refers to earlier rules only."""
    start = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.empty(int(start[-1]), np.int64)
    depth = np.zeros(len(rules), np.int64)
    done = 0
    while done < len(rules):  # rules up to the first that needs one of this step
        newer = np.flatnonzero((rules[done:] >= base + done).any(axis=1) & (np.arange(len(rules) - done) > 0))
        stop = done + int(newer[0]) if len(newer) else len(rules)
        step = np.arange(done, stop)
        place = start[step]
        for side in (0, 1):
            s = rules[step, side]
            plain = s < base
            flat[place[plain]] = s[plain]
            deep = np.flatnonzero(~plain)
            n = lengths[s[deep] - base]
            flat[ranges(place[deep], n)] = flat[ranges(start[s[deep] - base], n)]
            place = place + np.where(plain, 1, lengths[np.maximum(s - base, 0)] if len(lengths) else 1)
        depth[step] = 1
        done = stop
    return flat, start


def _width(most: int) -> int:
    return 16 if most < 1 << 16 else 32


def to_block(doc_ids: np.ndarray, bounds: np.ndarray, ids: np.ndarray, min_count: int = MIN_COUNT, nulls: int = 0) -> bytes:
    seq, rules, lengths, base = compress(ids, min_count)
    bits, of_length = _width(base + len(rules) - 1), _width(int(lengths.max()) if len(lengths) else 0)
    head = struct.pack("<4s7I", MAGIC, len(doc_ids), base, len(rules), len(seq), bits, of_length, nulls)
    symbol = f"<u{bits // 8}"
    return b"".join([head, doc_ids.astype("<i8").tobytes(), bounds.astype("<u4").tobytes(), rules.astype(symbol).tobytes(), lengths.astype(f"<u{of_length // 8}").tobytes(), seq.astype(symbol).tobytes()])


class Block:
    """A shard's documents; any range of ids can be read without expanding the rest."""

    def __init__(self, data: bytes):
        magic, n, self.base, n_rules, n_seq, bits, of_length, self.nulls = struct.unpack_from("<4s7I", data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        symbol, at = f"<u{bits // 8}", 32
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        at += 8 * n
        self.bounds = np.frombuffer(data, "<u4", n + 1, at).astype(np.int64)
        at += 4 * (n + 1)
        self.rules = np.frombuffer(data, symbol, 2 * n_rules, at).astype(np.int64).reshape(-1, 2)
        at += bits // 4 * n_rules
        self.lengths = np.frombuffer(data, f"<u{of_length // 8}", n_rules, at).astype(np.int64)
        self.seq = np.frombuffer(data, symbol, n_seq, at + of_length // 8 * n_rules)
        self._ends = np.cumsum(self._size(self.seq))

    def _size(self, seq: np.ndarray) -> np.ndarray:
        size = np.ones(len(seq), np.int64)
        deep = seq >= self.base
        size[deep] = self.lengths[seq[deep].astype(np.int64) - self.base]
        return size

    @cached_property
    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        flat, start = expansions(self.rules, self.lengths, self.base)
        return flat.astype(np.uint32), start

    def _few(self, seq: np.ndarray) -> np.ndarray:
        """The ids of some symbols: nonterminals give way to their pairs until none is left."""
        seq = seq.astype(np.int64)
        while (deep := seq >= self.base).any():
            out = np.repeat(seq, 1 + deep)
            at = (np.cumsum(1 + deep) - (1 + deep))[deep]
            out[at], out[at + 1] = self.rules[seq[deep] - self.base].T
            seq = out
        return seq

    def _many(self, seq: np.ndarray) -> np.ndarray:
        """The ids of many symbols, from the expansions of all rules."""
        flat, start = self._expansions
        deep = seq >= self.base
        rule = np.where(deep, seq, self.base).astype(np.int64) - self.base
        counts = self._size(seq)
        # plain ids stand behind the expansions, so that one gather reads both
        values = np.concatenate([flat, seq.astype(np.uint32)])
        place = np.where(deep, start[rule] if len(self.rules) else 0, len(flat) + np.arange(len(seq)))
        return values[ranges(place, counts)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop (not included) of the shard."""
        if stop <= start:
            return np.zeros(0, np.int64)
        a, b = int(np.searchsorted(self._ends, start, side="right")), int(np.searchsorted(self._ends, stop - 1, side="right")) + 1
        out = (self._few if 8 * (b - a) < len(self.seq) else self._many)(self.seq[a:b])
        before = int(self._ends[a - 1]) if a else 0
        return out[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.bounds[i]), int(self.bounds[i + 1]))


def _shards(size: np.ndarray, most: int, end: bool) -> tuple[list[tuple[int, int]], int]:
    """Ranges of whole documents with `most` ids together at most, or one longer document; and how many documents they take of all but, unless it is the end, the last range."""
    total = np.cumsum(size)
    found, at = [], 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        if stop == len(size) and not end:
            break
        found.append((at, stop))
        at = stop
    return found, at


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, min_count: int = MIN_COUNT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, compresses and writes; the table of blocks in the order of doc_id: part, shard, before (ids of the part's earlier shards), n_ids and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, shard, before = vocabulary(path), TaskContext.get().partitionId(), 0, 0
        doc_ids, known, size, ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int32)

        def made(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal doc_ids, known, size, ids, shard, before
            found, done = _shards(size, shard_ids, end)
            at = np.concatenate([[0], np.cumsum(size)])
            for a, b in found:
                block = to_block(doc_ids[a:b], at[a : b + 1] - at[a], ids[at[a] : at[b]], min_count, int((~known[a:b]).sum()))
                n = int(at[b] - at[a])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before]), pa.array([n]), pa.array([block], pa.binary())], names=["part", "shard", "before", "n_ids", "block"])
                shard, before = shard + 1, before + n
            doc_ids, known, size, ids = doc_ids[done:], known[done:], size[done:], ids[at[done] :].copy()
            give_back()

        for b in text_slices(batches, limit=SLICE_BYTES):
            new, off = bpe.encode(b.column("text"))
            ids = np.concatenate([ids, np.insert(new, off[1:], end_id)])
            size = np.concatenate([size, np.diff(off) + 1])
            doc_ids = np.concatenate([doc_ids, b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)])
            known = np.concatenate([known, b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)])
            yield from made(False)
        yield from made(True)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(1, shuffle_partitions(docs.sparkSession))
    # rows of one doc_id, or of none, may be many: they are told apart by their text, and equal rows, which may change places, by a number
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    order = ["doc_id", F.xxhash64("text"), "number"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ordered.mapInArrow(run, "part int, shard int, before long, n_ids long, block binary"), "token-shards")


def placed(shards: DataFrame) -> DataFrame:
    """first (ids of all earlier shards), n_ids and block of every shard."""
    # ids before a part: as many rows as there are partitions
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r["part"], before))
        before += r["n"]
    parts = shards.sparkSession.createDataFrame(rows, "part int, part_start long")
    return shards.join(F.broadcast(parts), "part").select((F.col("part_start") + F.col("before")).alias("first"), "n_ids", "block")


def read_range(shards: DataFrame, start: int, stop: int) -> DataFrame:
    """position and ids of the token ids from start to stop (not included) of all documents laid end to end: a row for each shard that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, data in zip(b.column("first").to_pylist(), b.column("n_ids").to_pylist(), b.column("block"), strict=True):
                a, z = max(start - first, 0), min(stop - first, n)
                yield pa.RecordBatch.from_arrays([pa.array([first + a]), pa.array([Block(data.as_py()).ids(a, z).tolist()], pa.list_(pa.int32()))], names=["position", "ids"])

    return placed(shards).filter((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start)).mapInArrow(run, "position long, ids array<int>")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the written blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b.column("first").to_pylist(), b.column("block"), strict=True):
                block = Block(data.as_buffer())
                raw = memoryview(block.ids(0, int(block.bounds[-1])).astype("<u4")).cast("B")
                cut = (4 * block.bounds).tolist()
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=np.arange(len(block.doc_ids)) < block.nulls), pa.array(first + block.bounds[:-1]), pa.array(np.diff(block.bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed(shards).select("first", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json")))


QUERIES = {"op10_repair_token_files": op10_repair_token_files}
