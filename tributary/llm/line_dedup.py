"""Operator 12, removal of lines that many documents have, by a sharded minimal perfect hash.

A line's key is the line without white space at its ends and in lower case (A-Z). Batches of texts send the 128-bit hash
of each distinct key with the number of their documents that have it; Spark sums these, and keys of `min_docs` documents
are the common ones. Their hashes are spread over shards, and each shard becomes an index of four packed arrays: the bits
of a minimal perfect hash (levels of bit arrays: a key that has its place alone is settled there, the others go on to the
next level), ranks of the bits, a 64-bit fingerprint for each slot, and a count for each slot. Documents are not joined
with lines: they probe the arrays, where a line that is not common meets another line's fingerprint.

While all shards together are below `index_bytes`, which is counted, they are broadcast and texts are cut in one pass.
Beyond, texts are put into blocks, each block sends its distinct hashes to the shards, one packed row a shard, and gets
back those that are common; shards are then so many that the probes of one fit in a task. Both ways give the same rows.

Defined cases: a null or empty text is one empty line. Lines whose key is shorter than `min_chars` code points stay.
Rows are documents: a line that a text has twice counts once, and rows with the same doc_id count each. A text without
lines left is empty. All columns stay, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import from_ipc, from_planes, planes, run_ends, run_starts, stored, text_blocks, text_bytes
from .common import bounded_batches, coded, give_back, mix64, table, text_slices, unused, written

MIN_DOCS, MIN_CHARS = 10, 1
#: Bytes of all shards up to which they are broadcast; bytes that a line takes of them, a little above what it does.
INDEX_BYTES, LINE_BYTES = 16 << 20, 14
#: Lines of a shard, and bytes of text whose lines go to one shard, on average.
SHARD_LINES, SHARD_TEXT = 1 << 17, 64 << 20
SLICE_BYTES, BLOCK_BYTES = 4 << 20, 4 << 20
#: The column that the result adds to the rows; underscores follow where they have one of that name.
RESULT = "__lines"
_SPACE = " \t\n\v\f\r"
_KEY = np.dtype([("h1", "<u8"), ("h2", "<u8")])
_TEXT = "text"


# lines, keys, hashes


def split_lines(text: pa.Array, min_chars: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a large_string array: offsets of the lines, the lines, each line's number among the distinct keys of min_chars (-1: none), and the keys' hashes."""
    lists = pc.split_pattern(text, "\n")
    lines, off = lists.flatten(), lists.offsets.to_numpy()
    code, keys = coded(pc.ascii_lower(pc.ascii_trim(lines, characters=_SPACE)))
    long = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
    number = np.where(long, np.cumsum(long) - 1, -1)
    digests = b"".join(map(xxhash.xxh3_128_digest, keys.filter(pa.array(long)).cast(pa.large_binary()).to_pylist()))
    return off, lines, number[code] if len(code) else code, np.frombuffer(digests, _KEY)


def _counted(min_chars: int):
    """Hashes of each batch's distinct keys, and how many of its documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, _TEXT, SLICE_BYTES):
            off, _, key, h = split_lines(b.column(_TEXT), min_chars)
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            once = np.unique(doc[key >= 0] * max(1, len(h)) + key[key >= 0]) % max(1, len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h["h1"].view(np.int64)), pa.array(h["h2"].view(np.int64)), pa.array(np.bincount(once, minlength=len(h)))], names=["h1", "h2", "n"])

    return run


def common_lines(texts: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 and n of the keys that min_docs documents have, written."""
    found = texts.select(F.col(_TEXT)).mapInArrow(_counted(min_chars), "h1 long, h2 long, n long")
    return written(found.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs), "common-lines")


# the index


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys["h1"] + keys["h2"] * np.uint64(2 * level + 1) + np.uint64(level)) % np.uint64(size)).astype(np.int64)


class LineIndex:
    """A shard: slots 0 to n - 1 of n keys, with fingerprints and counts."""

    def __init__(self, data: bytes):
        self.n, levels = struct.unpack_from("<QQ", data)
        self.sizes = np.frombuffer(data, "<u8", levels, 16)
        at, words = 16 + 8 * levels, int(self.sizes.sum()) // 64
        self.words = np.frombuffer(data, "<u8", words, at)
        self.ranks = np.frombuffer(data, "<u4", words, at + 8 * words)
        at += 12 * words
        self.prints = np.frombuffer(data, "<u8", self.n, at)
        self.counts = np.frombuffer(data, "<u4", self.n, at + 8 * self.n)

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
        """Of distinct keys. Counts above 32 bits are stored as the largest: they are compared with thresholds far below."""
        sizes, bits, left = [], [], keys
        while len(left):
            size = 64 * max(1, -(-len(left) // 64))  # about a bit for each key that is left
            place = _place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[place]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view("<u8")
        per = np.bitwise_count(words).astype(np.int64)
        ranks = (np.cumsum(per) - per).astype("<u4")
        head = struct.pack("<QQ", len(keys), len(sizes)) + np.array(sizes, "<u8").tobytes() + words.tobytes() + ranks.tobytes()
        index = LineIndex(head + bytes(12 * len(keys)))
        prints, stored_ = np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u4")
        slot = index.slots(keys)
        prints[slot], stored_[slot] = keys["h2"], np.minimum(counts, 0xFFFFFFFF)
        return head + prints.tobytes() + stored_.tobytes()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; -1 for some keys that are not in the shard, any slot for others."""
        slot, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            place = base + _place(keys[open_], level, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slot[open_[hit]] = (self.ranks[place >> 6] + below)[hit]
            open_, base = open_[~hit], base + size
        return slot

    def count(self, keys: np.ndarray) -> np.ndarray:
        """How many documents have each key; 0 for keys that are not in the shard."""
        slot = self.slots(keys)
        there = np.flatnonzero(slot >= 0)
        there = there[self.prints[slot[there]] == keys["h2"][there]]
        out = np.zeros(len(keys), np.int64)
        out[there] = self.counts[slot[there]]
        return out


def line_index(lines: DataFrame, shards: int) -> DataFrame:
    """shard and index (bytes) of the keys h1, h2, n."""

    def build(group: pa.Table) -> pa.Table:
        keys = np.empty(group.num_rows, _KEY)
        for c in ("h1", "h2"):
            keys[c] = group.column(c).to_numpy().view(np.uint64)
        order = np.argsort(keys, order=("h1", "h2"))
        data = LineIndex.build(keys[order], group.column("n").to_numpy()[order])
        return pa.table([group.column("shard").slice(0, 1), pa.array([data], pa.binary())], names=["shard", "index"])

    shard = F.pmod(F.shiftrightunsigned("h1", 1), F.lit(shards))
    return lines.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, index binary")


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys["h1"] >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The shards that keys lie in, and their places."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    first = run_starts(shard[order])
    for a, z in zip(first, run_ends(first, len(order)), strict=True):
        yield int(shard[order[a]]), order[a:z]


# cutting texts


def cut(b: pa.RecordBatch, min_chars: int, common: Callable[[np.ndarray], np.ndarray], with_text: bool) -> tuple[pa.Array, pa.StructArray]:
    """The texts of a batch without the lines whose keys are common, and how many lines they had and lost, and the digest."""
    text = b.column(_TEXT)
    off, lines, key, h = split_lines(text, min_chars)
    drop = np.append(common(h), False)[key] if len(key) else np.zeros(0, bool)
    lost = np.concatenate([[0], np.cumsum(drop)])[off]
    lost = np.diff(lost)
    touched = np.flatnonzero(lost)
    texts = text.cast(pa.large_binary()).to_pylist()
    if len(touched):
        keep = ~drop
        rest = lines.filter(pa.array(keep)).cast(pa.large_binary())
        at = np.concatenate([[0], np.cumsum(keep)])[off]
        for i in touched.tolist():
            texts[i] = b"\n".join(rest.slice(at[i], at[i + 1] - at[i]).to_pylist())
    digest = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
    made = pa.StructArray.from_arrays([pa.array(np.diff(off).astype(np.int64)), pa.array(lost.astype(np.int64)), digest], ["n_lines", "n_dropped", "kept_sha256"])
    return pa.array(texts if with_text else [b""] * len(texts), pa.large_binary()).cast(pa.large_string()), made


def _result(b: pa.RecordBatch, own: list[str], at: int, made: tuple[pa.Array, pa.StructArray]) -> pa.RecordBatch:
    columns = [made[0].cast(pa.string()) if i == at else b.column(c) for i, c in enumerate(own)]
    return pa.RecordBatch.from_arrays([*columns, made[1]], names=[*own, "cut"])


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text: str = "text", with_text: bool = True, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows with their texts cut and RESULT: n_lines (before), n_dropped and kept_sha256."""
    spark, names = docs.sparkSession, docs.columns
    at, own = names.index(text), [f"c{i}" for i in range(len(names))]
    own[at] = _TEXT
    rows = docs.toDF(*own).withColumn(_TEXT, F.col(_TEXT).cast("string"))
    schema = ", ".join(f"{o} {'string' if i == at else f.dataType.simpleString()}" for i, (o, f) in enumerate(zip(own, docs.schema.fields, strict=True)))
    schema += ", cut struct<n_lines: bigint, n_dropped: bigint, kept_sha256: string>"
    bounded_batches(spark)
    lines = common_lines(rows, min_docs, min_chars)
    n = lines.count()
    if n * LINE_BYTES <= index_bytes:
        shards = max(1, -(-n // SHARD_LINES))
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["index"]) for r in line_index(lines, shards).collect()})  # below index_bytes

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = {k: LineIndex(x) for k, x in held.value.items()}

            def common(h: np.ndarray) -> np.ndarray:
                out = np.zeros(len(h), bool)
                for k, place in _by_shard(h, shards):
                    if k in index:
                        out[place] = index[k].count(h[place]) >= min_docs
                return out

            for b in text_slices(batches, _TEXT, SLICE_BYTES):
                yield _result(b, own, at, cut(b, min_chars, common, with_text))

        return rows.mapInArrow(probe, schema).toDF(*names, unused(RESULT, names))

    blocks = text_blocks(rows, _TEXT, BLOCK_BYTES, "line-blocks")
    shards = max(-(-n // SHARD_LINES), -(-text_bytes(blocks) // SHARD_TEXT))
    blocks = blocks.drop("n_bytes")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in stored(batches):
            h = np.sort(split_lines(b.column(_TEXT), min_chars)[3], order=("h1", "h2"))
            found = [(k, planes(h[place])) for k, place in _by_shard(h, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([block] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["shard", "from", "keys"])
            give_back()

    def probed(group: pa.Table, index: pa.Table) -> pa.Table:
        found = []
        if index.num_rows:
            shard = LineIndex(index.column("index")[0].as_py())
            for block, data in zip(group.column("from").to_pylist(), group.column("keys"), strict=True):
                h = from_planes(data.as_py(), _KEY)
                h = h[shard.count(h) >= min_docs]
                if len(h):
                    found.append((block, planes(h)))
        return pa.table([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["to", "common"])

    def dropped(group: pa.Table, back: pa.Table) -> pa.Table:
        known = np.unique(np.concatenate([np.zeros(0, _KEY), *(from_planes(x.as_py(), _KEY) for x in back.column("common"))]))
        b = from_ipc(group.column("rows")[0])
        out = _result(b, own, at, cut(b, min_chars, lambda h: np.isin(h, known), with_text))
        give_back()
        return pa.Table.from_batches([out])

    probes = blocks.mapInArrow(sent, "shard long, from long, keys binary")
    back = probes.groupBy("shard").cogroup(line_index(lines, shards).groupBy("shard")).applyInArrow(probed, "to long, common binary")
    return blocks.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(dropped, schema).toDF(*names, unused(RESULT, names))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    r = F.col(RESULT)
    return found.select("doc_id", r["n_lines"].alias("n_lines"), r["n_dropped"].alias("n_dropped"), r["kept_sha256"].alias("kept_sha256"))


QUERIES = {"op12_line_dedup": op12_line_dedup}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = {
    "op12_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
