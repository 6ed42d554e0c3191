"""Operator 11, alignment of two tokenizers' ids on one text.

Both tokenizers' tokens cover the same bytes, a space and the text. Every byte gets a label: no token ends there (n), one
of A does (a), one of B (b), or both (c). A regular expression scans the labels for spans up to each c, and the labels of
a span say how many tokens of A and of B stand in that group. A byte with a label also ends one stretch that lies in one
token of A and one of B, so the labels but n are the links, the pairs of overlapping tokens.

Blocks of a few megabytes of text are aligned once and written with their distinct id pairs, each with the number of the
block's documents that hold it. The pairs are summed over all blocks by (A, B), and the sums come back to the blocks by a
join of those distinct pairs: the most frequent pair of all has one row a block, not one a document. What is highest of
an A id's pairs has a row for each entry of A's vocabulary at most, and is broadcast.

B's pieces begin words: where none has a space behind another character (that is looked up in the vocabulary), the text is
cut before each run of spaces, and each distinct cutting of a block is encoded once.

Defined cases: a null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens: zeros
and an empty string of groups. Strings of special tokens are plain text. Rows are documents: repeated rows count each for
itself, and a null doc_id stays null. Extra columns are left out; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import _ipc, from_ipc, from_planes, planes
from .bpe import BpeVocabulary, _gather, vocabulary_path
from .common import bounded_batches, coded, give_back, table, text_slices, written

#: Bytes of text that are aligned at once, a longer text alone; and rows.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 1 << 16
_PART_BLOCKS = 1 << 27
#: Labels by the sum of 1 (a token of A ends here) and 2 (of B).
_LABELS = np.frombuffer(b"nabc", np.uint8)
_SPAN = re.compile(rb"[nab]*c")
_USE = np.dtype([("doc", "<i4"), ("pair", "<i4"), ("n", "<i4")])
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class ByteLevel(BpeVocabulary):
    """A byte-level BPE file whose special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        if self.word_layout:
            raise ValueError("A needs a byte-level vocabulary")
        self.pieces = pa.array(self._pieces, pa.large_binary())
        self.special, self._special_re = {}, None


class Pieces:
    """A sentencepiece model with byte fallback that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        texts = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.pieces = pa.array([bytes([int(t[1:-1], 16)]) if m.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)], pa.large_binary())
        plain = [t for i, t in enumerate(texts) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.cuts = not any(re.search("[^▁]▁", t) for t in plain)
        self.space = m.piece_to_id("▁")

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts

    def encode(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of texts that have the space before them already."""
        off, data = _buffers(spaced)
        if not self.cuts:
            ids, counts = self._flat([t[1:] for t in spaced.to_pylist()])
            return ids, np.concatenate([[0], np.cumsum(counts)])
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[off[:-1]] = True
        first = np.flatnonzero(begins)
        part = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int64)), pa.py_buffer(data))
        code, distinct = coded(part)
        texts = [t[1:] for t in distinct.to_pylist()]
        ids, counts = self._flat(texts)
        for k in [k for k, t in enumerate(texts) if not t]:  # a space alone, at a text's end: an empty text would have no piece
            at = int(counts[:k].sum())
            ids, counts[k] = np.insert(ids, at, self.space), 1
        ids, counts = _gather(ids, counts, code)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.searchsorted(first, off)]


def _buffers(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a large string or binary array without nulls."""
    off = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return off - off[0], data


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


@lru_cache(maxsize=4)
def _numbers(size: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(size)], object)


@dataclass
class Aligned:
    """Tokens, groups and links of a batch of texts; offsets are by document, those without tokens being empty."""

    a: np.ndarray  # ids of A
    b: np.ndarray
    a_off: np.ndarray  # where each document's begin, and the end
    b_off: np.ndarray
    in_a: np.ndarray  # tokens of A in each group
    in_b: np.ndarray
    width: np.ndarray  # bytes of each group
    group_off: np.ndarray
    link_a: np.ndarray  # the A id of each link
    link_b: np.ndarray
    link_off: np.ndarray

    @staticmethod
    def of(text: pa.Array, a: ByteLevel, b: Pieces) -> Aligned:
        """Of a large_string array without nulls."""
        n = len(text)
        some = np.flatnonzero(pc.binary_length(text).to_numpy(zero_copy_only=False) > 0)
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text.take(pa.array(some)), pa.scalar(" ", pa.large_string()))
        off, data = _buffers(spaced)
        given = []
        whole = np.ones(len(some), bool)
        for t in (a, b):
            ids, at = t.encode(spaced)
            ends, made = _buffers(t.pieces.take(pa.array(ids)))
            bounds = ends[at]
            if not (np.array_equal(bounds, off) and np.array_equal(made, data)):
                whole &= [np.array_equal(made[x:y], data[u:v]) for x, y, u, v in zip(bounds[:-1], bounds[1:], off[:-1], off[1:], strict=True)]
            given.append((ids, at, ends))
        size = np.zeros(n, np.int64)
        size[some[whole]] = np.diff(off)[whole]
        byte_off = np.concatenate([[0], np.cumsum(size)])
        label = np.zeros(int(byte_off[-1]), np.uint8)
        kept, offs = [], []
        for bit, (ids, at, ends) in zip((1, 2), given, strict=True):
            count = np.diff(at)
            if not whole.all():
                use = np.repeat(whole, count)
                ids, ends = ids[use], np.concatenate([[0], np.cumsum(np.diff(ends)[use])])
            label[ends[1:] - 1] |= bit
            per = np.zeros(n, np.int64)
            per[some[whole]] = count[whole]
            kept.append(ids)
            offs.append(np.concatenate([[0], np.cumsum(per)]))
        ends_a, ends_b = label & 1, label >> 1
        spans = _SPAN.findall(_LABELS[label].tobytes())
        number = {s: i for i, s in enumerate(set(spans))}  # few: their labels are counted once
        counts = np.array([(s.count(b"a") + 1, s.count(b"b") + 1, len(s)) for s in number], np.int64).reshape(-1, 3)
        counts = counts[np.fromiter(map(number.__getitem__, spans), np.int64, len(spans))]
        place = np.flatnonzero(label)
        link_a = kept[0][(np.cumsum(ends_a, dtype=np.int64) - ends_a)[place]]
        link_b = kept[1][(np.cumsum(ends_b, dtype=np.int64) - ends_b)[place]]
        group_off = np.concatenate([[0], np.cumsum(label == 3, dtype=np.int64)])[byte_off]
        return Aligned(*kept, *offs, *counts.T, group_off, link_a, link_b, np.searchsorted(place, byte_off))

    def counts(self) -> dict[str, np.ndarray]:
        return {name: np.diff(x) for name, x in zip(_COUNTS, (self.a_off, self.b_off, self.group_off, self.link_off), strict=True)}

    def group_texts(self, size_a: int, size_b: int) -> Iterator[str]:
        """The groups of each document as decimal ids, `a1,a2|b1;a3|b2,b3`."""
        end_a, end_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        out = np.empty(len(self.a) + len(self.b), object)
        piece = _numbers(size_a, ",")[self.a]
        piece[end_a - 1] = _numbers(size_a, "|")[self.a[end_a - 1]]
        out[np.arange(len(self.a)) + np.repeat(end_b - self.in_b, self.in_a)] = piece
        piece = _numbers(size_b, ",")[self.b]
        piece[end_b - 1] = _numbers(size_b, ";")[self.b[end_b - 1]]
        out[np.arange(len(self.b)) + np.repeat(end_a, self.in_b)] = piece
        cut = (self.a_off + self.b_off).tolist()
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            yield "".join(out[x:y].tolist())[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct id pairs (A in the upper 32 bits), in how many documents each is, and the uses: document, pair, how often."""
        pair, at = np.unique((self.link_a.astype(np.int64) << 32) | self.link_b, return_inverse=True)
        doc = np.repeat(np.arange(len(self.link_off) - 1), np.diff(self.link_off))
        use, n = np.unique(doc * max(1, len(pair)) + at, return_counts=True)
        uses = np.empty(len(use), _USE)
        uses["doc"], uses["pair"], uses["n"] = use // max(1, len(pair)), use % max(1, len(pair)), n
        return pair, np.bincount(uses["pair"], minlength=len(pair)), uses


def token_groups(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the groups of every row: start and stop (bytes of the space and the text), ids of A, ids of B."""
    schema = "doc_id long, groups array<struct<start long, stop long, a array<int>, b array<int>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_slices(batches, limit=BLOCK_BYTES, rows=BLOCK_ROWS):
            g = Aligned.of(x.column("text"), *tokenizers(path_a, path_b))
            before = np.concatenate([[0], np.cumsum(g.width)])
            first = np.repeat(before[g.group_off[:-1]], np.diff(g.group_off))
            parts = [pa.array(before[:-1] - first), pa.array(before[1:] - first)]
            parts += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32())) for n, ids in ((g.in_a, g.a), (g.in_b, g.b))]
            groups = pa.ListArray.from_arrays(pa.array(g.group_off, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "stop", "a", "b"]))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), groups], names=["doc_id", "groups"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table of blocks on the shared folder: block, docs and uses (packed), and the block's distinct pairs a, b, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * _PART_BLOCKS
        a, b = tokenizers(path_a, path_b)
        for x in text_slices(batches, limit=BLOCK_BYTES, rows=BLOCK_ROWS):
            g = Aligned.of(x.column("text"), a, b)
            sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in g.group_texts(len(a.pieces), len(b.pieces))]
            rows = pa.RecordBatch.from_arrays([x.column("doc_id"), *(pa.array(v) for v in g.counts().values()), pa.array(sha, pa.string())], names=["doc_id", *_COUNTS, "groups_sha256"])
            pair, n, uses = g.pairs()
            del g
            columns = [pa.array([v.astype(np.int32)], pa.list_(pa.int32())) for v in (pair >> 32, pair & 0xFFFFFFFF, n)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_ipc(rows)], pa.binary()), pa.array([planes(uses)], pa.binary()), *columns], names=["block", "docs", "uses", "a", "b", "n"])
            number += 1
            give_back()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "block long, docs binary, uses binary, a array<int>, b array<int>, n array<int>"), "aligned")


def block_pairs(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("block").alias("of"), F.inline(F.arrays_zip("a", "b", "n")))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked) and best (no pair of this A id has a higher count), written."""
    counts = written(block_pairs(blocks).groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("count")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # a row for each entry of A's vocabulary at most
    return counts.join(F.broadcast(top), "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    blocks = aligned_blocks(docs, path_a, path_b, key, text)
    known = block_pairs(blocks).drop("n").join(pair_counts(blocks), ["a", "b"])
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"

    def scored(held: pa.Table, found: pa.Table) -> pa.Table:
        rows, uses = from_ipc(held.column("docs")[0]), from_planes(held.column("uses")[0].as_py(), _USE)
        found = found.sort_by([("a", "ascending"), ("b", "ascending")])  # the order of the block's pairs
        count, best = found.column("count").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        sums = [np.zeros(rows.num_rows, np.int64) for _ in range(2)]
        np.add.at(sums[0], uses["doc"], uses["n"] * best[uses["pair"]].astype(np.int64))
        np.add.at(sums[1], uses["doc"], uses["n"] * count[uses["pair"]])
        return pa.table([rows.column("doc_id"), *(rows.column(c) for c in _COUNTS), *sums, rows.column("groups_sha256")], names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    return blocks.select("block", "docs", "uses").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(scored, schema)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
