"""Blocks: a table's rows in packages of some megabytes of text, written once and read alike in every later stage.

A block has a number, so that what other stages find out about it can come back to it by a join, and packed arrays travel
between blocks and buckets, one row for each pair of them. A row's number is its block's times `ROWS` plus its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices, written

#: Rows that a block has at most.
ROWS = 1 << 16
_PART_BLOCKS = 1 << 27


def text_blocks(rows: DataFrame, text: str, size: int, name: str) -> DataFrame:
    """The table block, n_bytes (of text) and rows (packed), on the shared folder. Blocks have `size` bytes of text or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * _PART_BLOCKS
        for b in text_slices(batches, text, size, ROWS):
            n = b.column(text).nbytes
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), pa.array([_ipc(b)], pa.binary())], names=["block", "n_bytes", "rows"])
            number += 1

    bounded_batches(rows.sparkSession)
    return written(rows.mapInArrow(run, "block long, n_bytes long, rows binary"), name)


def text_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_bytes")).first()[0] or 0


def _ipc(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def from_ipc(rows: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows.as_buffer()).read_next_batch()


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Number and rows of every block in batches of the table of blocks."""
    for b in batches:
        for block, rows in zip(b.column("block").to_pylist(), b.column("rows"), strict=True):
            yield block, from_ipc(rows)


# packed arrays


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(x: np.ndarray) -> bytes:
    """The records of a structured array field by field and byte by byte, squeezed: sorted fields become small."""
    parts = [np.array([len(x)], "<i8").tobytes()]
    for name in x.dtype.names:
        field = np.ascontiguousarray(x[name])
        parts.append(field.view(np.uint8).reshape(len(x), x.dtype[name].itemsize).T.tobytes())
    return squeeze(b"".join(parts))


def from_planes(data: bytes, dtype: np.dtype) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    out, at = np.empty(n, dtype), 8
    for name in dtype.names:
        kind = dtype[name]
        plain = np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T)
        out[name] = plain.view(kind.base).reshape(n, *kind.shape)
        at += n * kind.itemsize
    return out


# runs of sorted arrays


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def run_ends(first: np.ndarray, n: int) -> np.ndarray:
    """Where the runs that begin at first end, n being the end of the last."""
    return np.append(first[1:], n) if len(first) else first


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def grouped(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal labels together, and where each group begins and ends in it."""
    order = np.argsort(label, kind="stable")
    first = run_starts(label[order])
    return order, first, run_ends(first, len(order))
