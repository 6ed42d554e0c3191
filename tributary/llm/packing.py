"""Operator 1, harmonic packing of token sequences.

A piece of length n has class k = capacity // n, so k pieces of its class always fit one bin: class k holds lengths in
(capacity / (k + 1), capacity / k], and its bins take exactly k pieces. Each worker fills the bins of its own rows,
class by class, without knowing of the others. What remains, fewer than k pieces for each class and worker, goes up a
tree: sixteen workers' rest is filled in the same way by one, and so on; the root's rest, bounded by the number of
classes whatever the input, is placed first-fit in order of decreasing length.

Documents are cut so that pieces nearly fill their class: whole capacities first, then, while the rest would waste
more than `tolerance` of itself, the largest class size below it. Rests of `min_cut` tokens or fewer stay whole; there
classes are so close that little is wasted.

Defined cases: a null text is empty; each document has its end id, so an empty one is a piece of length 1; rows with
the same id are separate documents; extra columns are left out; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ENCODE_BYTES, encode_rows, vocabulary, vocabulary_path
from .common import bounded_batches, table, text_slices, written

CAPACITY = 4096
END_ID = 2
TOLERANCE = 1 / 64
MIN_CUT = 64
FAN_IN = 16
#: Pieces that a worker holds before it fills bins.
HELD_PIECES = 200_000
_PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
_SCHEMA = ", ".join(f"{c} long" for c in _PIECE) + ", sequence_id long, offset long, part int"


def cut(n_tokens: np.ndarray, capacity: int = CAPACITY, tolerance: float = TOLERANCE, min_cut: int = MIN_CUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of every piece, in document order."""
    doc, start, length = [], [], []
    n_full = n_tokens // capacity
    d = np.repeat(np.arange(len(n_tokens)), n_full)
    doc.append(d)
    start.append((np.arange(len(d)) - np.repeat(np.cumsum(n_full) - n_full, n_full)) * capacity)
    length.append(np.full(len(d), capacity, np.int64))
    at, done, rest = np.arange(len(n_tokens)), n_full * capacity, n_tokens - n_full * capacity
    while True:
        open_ = rest > 0
        at, done, rest = at[open_], done[open_], rest[open_]
        if not len(at):
            break
        k = capacity // rest
        wasteful = (capacity // k - rest > tolerance * rest) & (rest > min_cut)
        piece = np.where(wasteful, capacity // (k + 1), rest)
        doc.append(at)
        start.append(done)
        length.append(piece)
        done, rest = done + piece, rest - piece
    doc, start, length = np.concatenate(doc), np.concatenate(start), np.concatenate(length)
    order = np.lexsort((start, doc))
    return doc[order], start[order].astype(np.int64), length[order].astype(np.int64)


def fill(length: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin (-1: none) and offset of every piece, and the number of bins; bins of class k take k pieces in order of arrival."""
    n = len(length)
    bin_, offset = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return bin_, offset, 0
    k = capacity // length
    order = np.argsort(k, kind="stable")
    ks = k[order]
    first = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
    count = np.diff(np.append(first, n))
    rank = np.arange(n) - np.repeat(first, count)
    full = count // ks[first]
    used = rank < np.repeat(full * ks[first], count)
    b = np.repeat(np.cumsum(full) - full, count) + rank // ks
    order, b = order[used], b[used]
    if not len(order):
        return bin_, offset, 0
    bin_[order] = b
    before = np.cumsum(length[order]) - length[order]
    opens = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    offset[order] = before - np.repeat(before[opens], np.diff(np.append(opens, len(b))))
    return bin_, offset, int(full.sum())


def first_fit_decreasing(length: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece, and the number of bins; for the root's bounded rest."""
    bin_, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    used = np.zeros(max(1, len(length)), np.int64)
    n = 0
    for i in np.argsort(-length, kind="stable"):
        fits = np.flatnonzero(used[:n] + length[i] <= capacity)
        b = int(fits[0]) if len(fits) else n
        n = max(n, b + 1)
        bin_[i], offset[i] = b, used[b]
        used[b] += length[i]
    return bin_, offset, n


def _filler(level: int, capacity: int, root: bool = False):
    """A function that fills bins of a partition's pieces and passes on the rest with a null sequence_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base, made = (level << 56) | (part << 32), 0
        held: list[np.ndarray] = []
        count = 0

        def batch(x: np.ndarray, seq: np.ndarray | None, offset: np.ndarray | None) -> pa.RecordBatch:
            none = pa.nulls(x.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(c, mask=None if i else x[5] == 1) for i, c in enumerate(x[:5])), none if seq is None else pa.array(seq), none if offset is None else pa.array(offset), pa.array(np.full(x.shape[1], part, np.int32))], names=[*_PIECE, "sequence_id", "offset", "part"])

        for b in batches:
            ids = b.column("doc_id")
            held.append(np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), *(b.column(c).to_numpy(zero_copy_only=False) for c in _PIECE[1:]), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)]))
            count += b.num_rows
            if count >= HELD_PIECES:
                x = np.concatenate(held, axis=1)
                bin_, offset, n = fill(x[2], capacity)
                yield batch(x[:, bin_ >= 0], base + made + bin_[bin_ >= 0], offset[bin_ >= 0])
                held, made = [x[:, bin_ < 0]], made + n
                count = held[0].shape[1]
        if held:
            x = np.concatenate(held, axis=1)
            bin_, offset, n = fill(x[2], capacity)
            yield batch(x[:, bin_ >= 0], base + made + bin_[bin_ >= 0], offset[bin_ >= 0])
            x, made = x[:, bin_ < 0], made + n
            if root:
                bin_, offset, _ = first_fit_decreasing(x[2], capacity)
                yield batch(x, base + made + bin_, offset)
            else:
                yield batch(x, None, None)

    return run


def _pieces(path: str, end_id: int, capacity: int, tolerance: float, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        end = np.array([end_id], "<u4")
        for b in text_slices(batches, limit=ENCODE_BYTES):
            ids, off = bpe.encode(b.column("text"))
            raw = ids.astype("<u4")
            n = np.diff(off) + 1
            doc, start, length = cut(n, capacity, tolerance, min_cut)
            crc = np.empty(len(doc), np.int64)
            for i, (d, s, m) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                last = s + m == n[d]
                value = zlib.crc32(raw[off[d] + s : off[d] + s + m - last])
                crc[i] = zlib.crc32(end, value) if last else value
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[doc])], names=list(_PIECE))

    return run


def pack(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, tolerance: float = TOLERANCE, min_cut: int = MIN_CUT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. Sequences are padded to the capacity."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut_, level_0 = _pieces(path, end_id, capacity, tolerance, min_cut), _filler(0, capacity)
    found = written(rows.mapInArrow(lambda batches: level_0(cut_(batches)), _SCHEMA), "packing-0")
    packed, level = found.filter("sequence_id IS NOT NULL"), 1
    rest = found.filter("sequence_id IS NULL")
    workers = rest.agg(F.countDistinct("part").alias("n")).first()["n"]
    while workers:
        workers = -(-workers // FAN_IN)
        root = workers == 1
        found = written(rest.repartition(workers).mapInArrow(_filler(level, capacity, root), _SCHEMA), f"packing-{level}")
        packed = packed.unionByName(found.filter("sequence_id IS NOT NULL"))
        if root:
            break
        rest, level = found.filter("sequence_id IS NULL"), level + 1
    return packed.drop("part")


def sequence_ids(docs: DataFrame, pieces: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id and the padded ids of every sequence, from the documents and their pieces; document ids must be unique."""
    ids = encode_rows(docs, path).select(F.col("doc_id").alias("of"), F.concat("ids", F.array(F.lit(end_id))).alias("ids"))
    parts = pieces.join(ids, F.col("doc_id") == F.col("of")).select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    joined = parts.groupBy("sequence_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("offset", "ids"))).getField("ids")).alias("ids"))
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))).alias("ids"))


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


QUERIES = {"op1_harmonic_packing": op1_harmonic_packing}
