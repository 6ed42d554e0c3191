"""What the corpus operators share: tables, the shared folder, and word codes of Arrow text batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import discard, scratch, shared_dir, written

__all__ = ["ascii_words", "bounded_batches", "byte_hashes", "coded", "discard", "mix64", "scratch", "shared_dir", "shuffle_partitions", "table", "text_slices", "unused", "written"]

#: Bytes of text that a Python worker handles at a time; a longer text is handled alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it while a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes and rows of a batch that goes from the JVM to Python. Whole texts make large rows: by the defaults (10,000 rows) a
#: batch has tens of megabytes, whose buffers the JVM's native heap does not give back.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's limits for Arrow batches to at most BATCH_BYTES and BATCH_ROWS."""
    conf = spark._jsparkSession.sessionState().conf()
    for name, now, most in (("maxBytesPerBatch", conf.arrowMaxBytesPerBatch(), BATCH_BYTES), ("maxRecordsPerBatch", conf.arrowMaxRecordsPerBatch(), BATCH_ROWS)):
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim, or a stand-in elsewhere."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Returns freed memory to the system: workers are kept between tasks, several on an executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Record batches put together and cut so that the texts of each hold about `limit` bytes, in `rows` rows at most; null texts become empty."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        held.clear()
        size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(size, base + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop

    held: list[pa.RecordBatch] = []
    n_bytes = n_rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        more = pc.sum(pc.binary_length(text)).as_py()
        if held and (n_bytes + more > limit or n_rows + batch.num_rows > rows):
            yield from cut(held)
            n_bytes = n_rows = 0
            give_back()
        held.append(batch.set_column(at, pa.field(column, pa.large_string()), text))
        n_bytes, n_rows = n_bytes + more, n_rows + batch.num_rows
        del batch, text
    if held:
        yield from cut(held)
        give_back()


def ascii_words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of a large_string array: the row of each word, and the words."""
    lists = pc.ascii_split_whitespace(text)
    words = lists.flatten()
    offsets = lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(text), dtype=np.int64), np.diff(offsets))
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        words, row = words.filter(pa.array(full)), row[full]
    return row, words


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Integer codes of the values, and the distinct values by code."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of uint64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_hashes(values: pa.Array) -> np.ndarray:
    """A uint64 hash of each binary or string value, by its bytes."""
    values = values.cast(pa.large_binary())
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(values) else np.zeros(0, np.uint8)
    lens = np.diff(off)
    out = np.zeros(len(values), np.uint64)
    if len(data):
        place = np.arange(len(data), dtype=np.int64) - np.repeat(off[:-1] - off[0], lens)
        term = mix64(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(0x9E3779B97F4A7C15))
        full = lens > 0
        out[full] = np.add.reduceat(term, (off[:-1] - off[0])[full])
    return mix64(out + lens.astype(np.uint64))
