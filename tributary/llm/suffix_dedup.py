"""Operator 5, removal of repeated passages with common-prefix interval trees over enhanced suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller doc_id. Texts stay in
blocks of a few megabytes; what meets across blocks is far smaller than the texts:

0. A document whose text, of `length` bytes or more, also is that of a document with a smaller doc_id goes as a whole and
   takes no part in the rest: what it has in common with others its original has too.
1. Anchors. Every window of `length` bytes has an anchor, the k-gram of least hash in it (a minimizer), so equal windows
   have equal anchors. Blocks send their distinct anchors' hashes to buckets, with the number of documents that have them.
2. Buckets return to each block which of its anchors two documents or more have.
3. Consecutive windows with one repeated anchor form a unit, a snippet of at most `length` + w - 1 bytes. Blocks send each
   distinct unit once, with its least doc_id, to the bucket of its anchor. Units of anchors that have more than `HOT_UNITS`
   are split into their windows, each with its bytes, which spread over the buckets by their own hash.
4. A bucket sorts the suffixes of its units, finds the lengths of common prefixes of neighbours, and scans them with a
   stack into the tree of common-prefix intervals. Intervals of `length` bytes or more whose occurrences have different
   left neighbours (or stand at a unit's start) are the maximal repeats, each with all its occurrences. An occurrence
   whose unit has a larger least doc_id than the group learns the group's for all its windows. Equal units are one leaf of
   the tree, with all their occurrences; a unit whose anchor has no other is a tree of one leaf.
5. Blocks get these doc_ids back and remove what a smaller doc_id has.

Between the stages packed arrays travel, one row for a block and a bucket. Hashes only bring strings together: units are
equal, and windows are repeated, if their bytes are. Equal whole texts are told by 128-bit BLAKE2 digests. Buckets are as
many as the counted bytes of text need. Texts are worked through in pieces of `CHUNK` bytes and buckets' suffixes in
batches of whole anchors, so that a long text takes little more memory than its own bytes.

Defined cases: a null text is empty; a text shorter than `length` loses nothing; rows with the same doc_id take nothing
from each other; a null doc_id counts as larger than all others; extra columns are kept; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import expand, from_ipc, from_planes, grouped, planes, ranges, run_ends, run_starts, squeeze, stored, text_blocks, text_bytes
from .common import give_back, mix64, table, unused, written

LENGTH = 50
ANCHOR = 24
#: Anchors of more units than this, about 250 bytes of memory each, are split into windows.
HOT_UNITS = 1_000_000
BLOCK_BYTES = 2 << 20
#: Bytes of text whose anchors a bucket gets on the average.
BUCKET_BYTES = 8 << 20
#: Bytes of a text that are worked on at a time; windows of a bucket's units, and suffixes that are sorted, at a time.
CHUNK = 1 << 19
WINDOWS, SUFFIXES = 1 << 18, 1 << 16
#: Windows whose hashes are held at a time.
PART_WINDOWS = 1 << 21
#: Up to so many texts with copies, 24 bytes each, are broadcast.
BROADCAST_COPIES = 200_000
_LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x, dtype=np.uint64)


def string_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the strings data[start:stop], in pieces of data."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    longest = int((stop - start).max())
    powers, inverse = _powers(_BASE, min(len(data), CHUNK + longest)), _powers(pow(_BASE, -1, 1 << 64), CHUNK)
    piece = start // CHUNK
    order, lo, hi = grouped(piece)
    for i, j in zip(lo, hi, strict=True):
        at = order[i:j]
        base = int(piece[at[0]]) * CHUNK
        d = data[base : base + CHUNK + longest]
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(_VALUES[d] * powers[: len(d)], out=sums[1:])
        a = start[at] - base
        out[at] = mix64((sums[stop[at] - base] - sums[a]) * inverse[a])
    return out


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of k bytes: those of 1, 2, 4 ... bytes are put together."""
    x, width = _VALUES[data], 1
    out, used = np.zeros(len(data) + 1, np.uint64), 0
    while True:
        if k & width:
            m = len(data) - used - width + 1
            out = out[:m] + _power(used) * x[used : used + m]
            used += width
        if 2 * width > k:
            return mix64(out)
        x = x[:-width] + _power(width) * x[width:]
        width *= 2


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are equal."""
    out = np.ones(len(a), bool)
    if not len(a):
        return out
    width = int(size.max())
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)
    step, place = max(1, CHUNK // width), np.arange(width)
    for i in range(0, len(a), step):
        s = slice(i, i + step)
        out[s] = ~((rows[a[s]] != rows[b[s]]) & (place < size[s, None])).any(axis=1)
    return out


@dataclass
class Text:
    """The concatenated documents of a block."""

    doc_ids: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, doc_ids: pa.Array, text: pa.Array) -> Text:
        raw = text.cast(pa.large_binary())
        off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(raw) else np.zeros(0, np.uint8)
        return cls(doc_ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64), off - off[0], data)

    def units(self, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: first window, number of windows, hash of the anchor (48 bits), document number."""
        n, w = len(self.data) - length + 1, length - k + 1
        none = np.zeros(0, np.int64)
        if n < 1:
            return none, none, none.astype(np.uint64), none
        first, anchor, hashes = [], [], []
        for a in range(0, n, CHUNK):
            b = min(n, a + CHUNK)
            h = gram_hashes(self.data[a : b + length - 1], k)
            order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while 2 * span <= w:  # least over windows of 1, 2, 4 ... places
                order = np.minimum(order[:-span], order[span:])
                span *= 2
            if w > span:
                order = np.minimum(order[: len(order) - (w - span)], order[w - span :])
            at = run_starts(order)
            place = (order[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first.append(at + a)
            anchor.append(place + a)
            hashes.append(h[place])
        first, anchor, hashes = np.concatenate(first), np.concatenate(anchor), np.concatenate(hashes)
        at = run_starts(anchor)  # runs that go on in the next piece
        first, hashes = first[at], hashes[at]
        # documents cut the runs; windows that reach into the next document are none
        begin, end = self.bounds[:-1], np.maximum(self.bounds[1:] - length + 1, self.bounds[:-1])
        cut = np.unique(np.concatenate([first, begin, end]))
        cut = cut[cut < n]
        doc = np.searchsorted(self.bounds, cut, side="right") - 1
        size = run_ends(cut, n) - cut
        valid = cut < end[doc]
        cut, size, doc = cut[valid], size[valid], doc[valid]
        # least hashes are small: mixed again, they spread evenly over the buckets
        return cut, size, mix64(hashes[np.searchsorted(first, cut, side="right") - 1] * np.uint64(_BASE)) >> np.uint64(16), doc


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of 48-bit hashes, so that a bucket's sorted hashes share their leading bytes."""
    return (((h >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


# 0: copies

_COPY_ROW = "block long, place int, doc_id long, h1 long, h2 long"


def _text_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in stored(batches):
            raw = b.column(TEXT).cast(pa.large_binary())
            long_ = np.flatnonzero(pc.binary_length(raw).to_numpy(zero_copy_only=False) >= length)
            h = np.frombuffer(b"".join(hashlib.blake2b(raw[int(i)].as_buffer(), digest_size=16).digest() for i in long_), np.int64).reshape(-1, 2)
            ids = b.column(KEY).fill_null(_LAST).take(pa.array(long_))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(long_), block)), pa.array(long_.astype(np.int32)), ids, pa.array(h[:, 0]), pa.array(h[:, 1])], names=["block", "place", "doc_id", "h1", "h2"])

    return run


def _copies(hashes: DataFrame) -> DataFrame:
    """block and places: the documents of a block that are copies of one with a smaller doc_id."""
    least = hashes.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("h1", "h2", "least")
    least = written(least, "dedup-least")
    few = least.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    found = hashes.join(F.broadcast(least) if few else least, ["h1", "h2"]).filter("doc_id > least")
    return found.groupBy("block").agg(F.collect_list("place").alias("places"))  # a block's documents at most


def _without(t: Text, copies: pa.ChunkedArray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The units of documents that are no copies; the last column is the document's number."""
    gone = np.zeros(len(t.doc_ids), bool)
    for x in copies.to_pylist():
        gone[x or []] = True
    keep = ~gone[columns[-1]]
    return tuple(c[keep] for c in columns)


# 1 and 2: which anchors are repeated

_ANCHOR = np.dtype([("low", "<u4"), ("high", "<u2"), ("n", "u1"), ("units", "<u2")])
_ANCHOR_ROW = "bucket long, block long, anchors binary"


def _hash(x: np.ndarray) -> np.ndarray:
    return x["low"].astype(np.uint64) | (x["high"].astype(np.uint64) << np.uint64(32))


def _packed_anchors(h: np.ndarray, n: np.ndarray, units: np.ndarray | int = 0) -> np.ndarray:
    x = np.empty(len(h), _ANCHOR)
    x["low"], x["high"], x["n"], x["units"] = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32), n, units
    return x


def _anchors(length: int, k: int, buckets: int):
    def run(group: pa.Table, copies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "anchors": pa.array([], pa.binary())})
        b = from_ipc(group.column("rows")[0])
        t = Text.of(b.column(KEY), b.column(TEXT))
        _, _, h, doc = _without(t, copies.column("places"), *t.units(length, k))
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new_doc = np.ones(len(h), np.int64)
        new_doc[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = run_starts(h)
        count = np.minimum(np.add.reduceat(new_doc, first), 255) if len(first) else first
        x = _packed_anchors(h[first], count, np.minimum(run_ends(first, len(h)) - first, 0xFFFF))
        bucket = _bucket(h[first], buckets)  # ascending with the hashes
        lo = run_starts(bucket)
        hi = run_ends(lo, len(bucket))
        block = group.column("block")[0].as_py()
        give_back()
        return pa.table({"bucket": bucket[lo], "block": np.full(len(lo), block, np.int64), "anchors": pa.array([planes(x[i:j]) for i, j in zip(lo, hi, strict=True)], pa.binary())})

    return run


def _repeated(rows: pa.Table) -> pa.Table:
    """Of one bucket, for each block: its anchors that several documents have, and whether they are hot."""
    blobs, blocks = [from_planes(x.as_py(), _ANCHOR) for x in rows.column("anchors")], rows.column("block").to_numpy()
    x = np.concatenate(blobs)
    h, count, units = _hash(x), x["n"].astype(np.int64), x["units"].astype(np.int64)
    owner = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
    order = np.argsort(h, kind="stable")
    h, count, units, owner = h[order], count[order], units[order], owner[order]
    first = run_starts(h)
    many = run_ends(first, len(h)) - first
    keep = np.repeat(np.add.reduceat(count, first) > 1, many) if len(h) else np.zeros(0, bool)
    hot = np.repeat(np.add.reduceat(units, first) > HOT_UNITS, many) if len(h) else keep
    h, owner, hot = h[keep], owner[keep], hot[keep]
    order, lo, hi = grouped(owner)
    packed = _packed_anchors(h[order], hot[order])
    return pa.table({"block": blocks[owner[order[lo]]] if len(h) else np.zeros(0, np.int64), "anchors": pa.array([planes(packed[i:j]) for i, j in zip(lo, hi, strict=True)], pa.binary())})


# 3: units of repeated anchors


def distinct_strings(data: np.ndarray, start: np.ndarray, size: np.ndarray, content: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings by key, hash of their content and doc, and where in it a string's bytes are not those of the one before."""
    order = np.lexsort((doc, size, content, key))
    new = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    maybe = np.flatnonzero((key[a] == key[b]) & (content[a] == content[b]) & (size[a] == size[b]))
    new[1 + maybe] = ~same_bytes(data, start[a[maybe]], start[b[maybe]], size[a[maybe]])
    return order, new


_UNIT = np.dtype([("low", "<u4"), ("high", "<u2"), ("doc", "<i8"), ("id", "<u4"), ("size", "<u2")])
_UNIT_ROW = "bucket long, block long, units binary, snippets binary"


def _units_of(length: int, k: int, buckets: int):
    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        known = [from_planes(x.as_py(), _ANCHOR) for x in found.column("anchors") if x.is_valid]
        if not known or not group.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "units": pa.array([], pa.binary()), "snippets": pa.array([], pa.binary())})
        block = group.column("block")[0].as_py()
        b = from_ipc(group.column("rows")[0])
        t = Text.of(b.column(KEY), b.column(TEXT))
        first, n, h, doc = _without(t, found.column("places"), *t.units(length, k))
        known = np.concatenate(known)
        known_h = _hash(known)
        order = np.argsort(known_h)
        known_h, hot = known_h[order], known["n"][order] == 1
        at = np.minimum(np.searchsorted(known_h, h), len(known_h) - 1)
        use = known_h[at] == h
        first, n, h, doc, hot = first[use], n[use], h[use], doc[use], hot[at[use]]
        # windows of hot anchors are units of one window, keyed by their own hash
        plain, alone = int((~hot).sum()), np.repeat(doc[hot], n[hot])
        first = np.concatenate([first[~hot], ranges(first[hot], n[hot])])
        n = np.concatenate([n[~hot], np.ones(len(alone), np.int64)])
        doc = np.concatenate([doc[~hot], alone])
        content = string_hashes(t.data, first, first + n + length - 1)
        h = np.concatenate([h[~hot], content[plain:] >> np.uint64(16)])
        ids = t.doc_ids[doc]
        order, new = distinct_strings(t.data, first, n + length - 1, content, h, ids)
        head = np.flatnonzero(new)
        unit = np.empty(len(order), np.int64)
        unit[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        one = order[head]  # of each distinct unit the occurrence with the least doc_id, in the order of keys
        size = n[one] + length - 1
        place = np.argsort(first, kind="stable")
        own = np.empty(len(place), _RUN)
        own["step"], own["n"], own["unit"] = np.diff(first[place], prepend=0), n[place], unit[place]
        key_of, least = h[one], ids[one]
        x = np.empty(len(one), _UNIT)
        x["low"], x["high"], x["doc"], x["id"], x["size"] = key_of & np.uint64(0xFFFFFFFF), key_of >> np.uint64(32), least, np.arange(len(one)), size
        rows = [(buckets + block % buckets, planes(own), squeeze(least.astype("<i8").tobytes()))]
        bucket = _bucket(key_of, buckets)
        lo = run_starts(bucket)
        for i, j in zip(lo, run_ends(lo, len(bucket)), strict=True):
            rows.append((int(bucket[i]), planes(x[i:j]), squeeze(t.data[ranges(first[one[i:j]], size[i:j])].tobytes())))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "units": pa.array([r[1] for r in rows], pa.binary()), "snippets": pa.array([r[2] for r in rows], pa.binary())})

    return run


#: A block's own list of windows: steps between first windows, numbers of windows, and units.
_RUN = np.dtype([("step", "<u4"), ("n", "<u2"), ("unit", "<u4")])
_BACK_ROW = "block long, own binary, least binary, news binary"


# 4: enhanced suffix arrays of the buckets

def suffix_array(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes data[start:stop], and how many bytes each shares with the one before it (0 for the first)."""
    size = stop - start
    width = 8 * -(-int(size.max()) // 8) if len(size) else 8
    rows = np.zeros((len(start), width), np.uint8)
    place = np.arange(width)
    for at in range(0, len(start), 1 << 16):  # in pieces: an index array is eight times the bytes
        s = slice(at, at + (1 << 16))
        inside = place < size[s, None]
        rows[s][inside] = data[(start[s, None] + place)[inside]]
    words = rows.view(np.uint64).byteswap(inplace=True).reshape(len(rows), -1)  # bytes in the order of their weight
    order = np.lexsort(words.T[::-1])
    shared = np.zeros(len(start), np.int64)
    for at in range(1, len(start), 1 << 14):
        a, b = words[order[at - 1 : at - 1 + (1 << 14)]], words[order[at : at + (1 << 14)]]
        differ = a[: len(b)] ^ b
        where = (differ != 0).argmax(axis=1)
        first = differ[np.arange(len(b)), where]
        equal = sum((first >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(8))  # its leading zero bytes
        shared[at : at + len(b)] = np.where(first == 0, width, 8 * where + equal)
    shared[1:] = np.minimum(shared[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    return order, shared


def maximal_repeats(shared: np.ndarray, left: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The common-prefix intervals of `length` or more bytes whose suffixes differ in what stands before them.

    shared, left and doc are in the order of the suffix array; left is the byte before a suffix, -1 where there is none.
    Gives each interval's common length, first and last place, and least doc. All suffixes of an interval are its
    occurrences, not just neighbours; an interval whose left bytes agree lies inside a longer one.
    """
    size, first, last, least = [], [], [], []
    stack: list[list[int]] = []  # length, first place, least doc, left byte (-1: they differ)
    n = len(shared)
    ends = np.append(shared[1:], 0)
    # only places that share enough with a neighbour matter; where nothing is open the scan jumps to the next of them
    busy = np.flatnonzero((ends >= length) | (shared >= length))
    ends_, docs_, left_ = ends[busy].tolist(), doc[busy].tolist(), left[busy].tolist()
    for place, common, d, c in zip(busy.tolist(), ends_, docs_, left_, strict=True):
        begin = place
        while stack and stack[-1][0] > common:
            top = stack.pop()
            if d < top[2]:
                top[2] = d
            if c != top[3]:
                top[3] = -1
            if top[3] == -1:
                size.append(top[0])
                first.append(top[1])
                last.append(place)
                least.append(top[2])
            begin, d, c = top[1], top[2], top[3]
        if common >= length:
            if stack and stack[-1][0] == common:
                top = stack[-1]
                if d < top[2]:
                    top[2] = d
                if c != top[3]:
                    top[3] = -1
            else:
                stack.append([common, begin, d, c])
    assert not stack, n
    return tuple(np.array(x, np.int64) for x in (size, first, last, least))


def _repeated_windows(snippet: np.ndarray, n_windows: np.ndarray, start: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of the snippets (snippet, offset) whose hash occurs more than once, all with one hash together, about `SUFFIXES` or one hash's at a time.

    Hashes are computed for `PART_WINDOWS` windows at a time, and in as many rounds, by classes of the hash, as there are
    such parts: a round keeps its class's windows only. Suffixes with `length` bytes in common begin with one window.
    """
    total = np.cumsum(n_windows[snippet])
    if not len(total):
        return
    parts = -(-int(total[-1]) // PART_WINDOWS)
    cuts = np.searchsorted(total, np.arange(1, parts + 1) * PART_WINDOWS)
    for turn in range(parts):
        held = []
        for i, j in zip(np.append(0, cuts[:-1]), np.append(cuts[:-1], len(snippet)), strict=True):
            some = np.repeat(snippet[i:j], n_windows[snippet[i:j]])
            offset = ranges(np.zeros(j - i, np.int64), n_windows[snippet[i:j]])
            at = start[some] + offset
            h = string_hashes(data, at, at + length)
            mine = h % np.uint64(parts) == turn if parts > 1 else np.ones(len(h), bool)
            held.append((h[mine], some[mine].astype(np.int32), offset[mine].astype(np.uint16)))
        h, some, offset = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.argsort(h, kind="stable")
        first = run_starts(h[order])
        size = run_ends(first, len(order)) - first
        keep = np.repeat(size > 1, size)
        order, size = order[keep], size[size > 1]
        if not len(order):
            continue
        batch = (np.cumsum(size) - size) // SUFFIXES
        ends = np.cumsum(size)[run_ends(run_starts(batch), len(batch)) - 1]
        for i, j in zip(np.append(0, ends[:-1]), ends, strict=True):
            yield some[order[i:j]].astype(np.int64), offset[order[i:j]].astype(np.int64)


def _learn(best: np.ndarray, base: np.ndarray, pick: np.ndarray, n_windows: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray, rank: np.ndarray, length: int) -> None:
    """Sets for the windows of the picked snippets the least rank (of doc_ids) that has them. Every window that occurs twice begins a suffix."""
    for snippet, offset in _repeated_windows(pick, n_windows, start, data, length):
        at = start[snippet] + offset
        sa, shared = suffix_array(data, at, start[snippet] + size[snippet])
        left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1)
        common, lo, hi, doc = maximal_repeats(shared, left[sa], rank[snippet[sa]], length)
        spread = hi - lo + 1
        occurrence = sa[ranges(lo, spread)]
        common, doc = np.repeat(common, spread), np.repeat(doc, spread)
        learns = doc < rank[snippet[occurrence]]
        occurrence, common, doc = occurrence[learns], common[learns], doc[learns]
        covered = common - length + 1
        for i in range(0, len(occurrence), SUFFIXES):
            o, n = occurrence[i : i + SUFFIXES], covered[i : i + SUFFIXES]
            np.minimum.at(best, ranges(base[snippet[o]] + offset[o], n), np.repeat(doc[i : i + SUFFIXES], n).astype(np.int32))


def _news(u: np.ndarray, unit_key: np.ndarray, order: np.ndarray, new: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the units of some anchors (in order; new where a snippet begins): units, and runs of their windows that a smaller doc_id has."""
    text = np.cumsum(new) - 1  # the distinct snippet of each unit
    one = order[new]
    doc_ids, rank = np.unique(u["doc"][order], return_inverse=True)
    n_windows = size[one] - length + 1
    base = np.cumsum(n_windows) - n_windows
    best = np.repeat(rank[new].astype(np.int32), n_windows)
    first = run_starts(unit_key[one])
    many = run_ends(first, len(one)) - first
    several = np.repeat(many > 1, many)
    suffixes = np.add.reduceat(np.where(several, n_windows, 0), first)
    batch = np.repeat((np.cumsum(suffixes) - suffixes) // SUFFIXES, many)
    pick = np.flatnonzero(several)
    for i, j in zip(*grouped(batch[pick])[1:], strict=True):
        _learn(best, base, pick[i:j], n_windows, start[one], size[one], data, rank[new], length)
    # back to the units, some at a time: only doc_ids smaller than the block's own are news
    unit_parts, parts = [np.zeros(0, np.int64)], [np.zeros(0, _NEWS)]
    turn = (np.cumsum(n_windows[text]) - 1) // WINDOWS
    for i, j in zip(run_starts(turn), run_ends(run_starts(turn), len(turn)), strict=True):
        per_unit = n_windows[text[i:j]]
        value = best[ranges(base[text[i:j]], per_unit)]
        unit = np.repeat(np.arange(i, j), per_unit)
        index = ranges(np.zeros(j - i, np.int64), per_unit)
        news = value < rank[unit]
        value, unit, index = value[news], unit[news], index[news]
        begins = np.ones(len(value), bool)
        begins[1:] = (unit[1:] != unit[:-1]) | (value[1:] != value[:-1]) | (index[1:] != index[:-1] + 1)
        head = np.flatnonzero(begins)
        found = np.empty(len(head), _NEWS)
        found["doc"], found["id"], found["first"], found["n"] = doc_ids[value[head]], u["id"][order[unit[head]]], index[head], np.diff(np.append(head, len(value)))
        unit_parts.append(order[unit[head]])
        parts.append(found)
    return np.concatenate(unit_parts), np.concatenate(parts)


def _resolved(length: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of one bucket: for each block, windows of its units that a smaller doc_id has, with that doc_id. Blocks' own lists pass."""
        none = pa.nulls(rows.num_rows, pa.binary())
        if rows.column("bucket")[0].as_py() >= buckets:
            return pa.table({"block": rows.column("block"), "own": rows.column("units"), "least": rows.column("snippets"), "news": none})
        blocks = rows.column("block").to_numpy()
        units = [from_planes(x.as_py(), _UNIT) for x in rows.column("units")]
        owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
        u = np.concatenate(units)
        unit_key = _hash(u)
        data = np.frombuffer(b"".join(expand(x.as_py()) for x in rows.column("snippets")), np.uint8)
        size = u["size"].astype(np.int64)
        start = np.cumsum(size) - size
        order, new = distinct_strings(data, start, size, string_hashes(data, start, start + size), unit_key, u["doc"])
        # some anchors at a time: windows of different anchors differ
        windows = (size - length + 1)[order]
        first = run_starts(unit_key[order])
        of_anchor = np.add.reduceat(windows, first)
        batch = np.repeat((np.cumsum(of_anchor) - of_anchor) // WINDOWS, run_ends(first, len(order)) - first)
        lo = run_starts(batch)
        found = [_news(u, unit_key, order[i:j], new[i:j], start, size, data, length) for i, j in zip(lo, run_ends(lo, len(batch)), strict=True)]
        unit, found = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order, lo, hi = grouped(owner[unit])
        news = pa.array([planes(found[order[i:j]]) for i, j in zip(lo, hi, strict=True)], pa.binary())
        none = pa.nulls(len(news), pa.binary())
        out = pa.table({"block": blocks[owner[unit][order[lo]]] if len(unit) else np.zeros(0, np.int64), "own": none, "least": none, "news": news})
        del u, data, found, units
        give_back()
        return out

    return run


_NEWS = np.dtype([("doc", "<i8"), ("id", "<u4"), ("first", "<u2"), ("n", "<u2")])


# 5: what goes

def _removed(t: Text, own: bytes | None, least: bytes | None, news: list[bytes], copies: list[int], length: int) -> np.ndarray:
    """Whether each byte of a block goes."""
    depth = np.zeros(len(t.data) + 1, np.int32)
    for i in copies:
        depth[t.bounds[i]] += 1
        depth[t.bounds[i + 1]] -= 1
    if own is None:
        return np.cumsum(depth[:-1], dtype=np.int32) > 0
    runs = from_planes(own, _RUN)
    first, n, unit = np.cumsum(runs["step"].astype(np.int64)), runs["n"].astype(np.int64), runs["unit"].astype(np.int64)
    of_unit = np.frombuffer(expand(least), "<i8")
    mine = t.doc_ids[np.searchsorted(t.bounds, first, side="right") - 1]
    whole = of_unit[unit] < mine  # a smaller doc_id of this block has the same unit
    np.add.at(depth, first[whole], 1)
    np.add.at(depth, first[whole] + n[whole] + length - 1, -1)
    if news:
        x = np.concatenate([from_planes(b, _NEWS) for b in news])
        x = x[np.argsort(x["id"], kind="stable")]
        head = np.searchsorted(x["id"], np.arange(len(of_unit)))
        size = np.searchsorted(x["id"], np.arange(len(of_unit)), side="right") - head
        run = np.repeat(np.arange(len(runs)), size[unit])
        y = x[ranges(head[unit], size[unit])]
        goes = y["doc"] < mine[run]
        start = first[run[goes]] + y["first"][goes]
        np.add.at(depth, start, 1)
        np.add.at(depth, start + y["n"][goes].astype(np.int64) + length - 1, -1)
    return np.cumsum(depth[:-1], dtype=np.int32) > 0


def _cut(length: int, names: list[str], text: int, with_text: bool):
    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        b = from_ipc(group.column("rows")[0])
        t = Text.of(b.column(KEY), b.column(TEXT))
        own, least, news, copies = None, None, [], []
        for o, l, y, c in zip(*(found.column(x).to_pylist() for x in ("own", "least", "news", "places")), strict=True):
            if o is not None:
                own, least = o, l
            if y is not None:
                news.append(y)
            copies += c or []
        goes = _removed(t, own, least, news, copies, length)
        spans, kept, digest, removed = [], [], [], []
        for a, z in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True):
            mask = goes[a:z]
            removed.append(int(np.count_nonzero(mask)))
            if not removed[-1]:
                rest = t.data[a:z].tobytes()
                spans.append([])
            else:
                rest = t.data[a:z][~mask].tobytes()
                edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]).astype(np.int8))
                spans.append([{"start": int(s), "stop": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore") if with_text else "")
        cut = pa.StructArray.from_arrays([pa.array(np.diff(t.bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(digest, pa.string())], ["n_bytes", "n_removed", "spans", "kept_sha256"])
        give_back()
        cols = [pa.array(kept, pa.string()) if i == text else b.column(c) for i, c in enumerate(names)]
        return pa.table([*cols, cut], names=[*names, "cut"])

    return run


#: The column that the result of `remove_repeats` adds to the rows; underscores follow where they have one of that name.
RESULT = "__dedup"
#: Columns of a block: doc_id, text, and the rows' own as c0, c1 ...
KEY, TEXT = "doc_id", "text"


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """The rows with their texts cut (bytes of broken characters go too) and RESULT: n_bytes, n_removed, spans and kept_sha256 of the kept bytes."""
    names = docs.columns
    own, at = [f"c{i}" for i in range(len(names))], names.index(text)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias(KEY), F.col(f"`{text}`").cast("string").alias(TEXT), *(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True) if c != text))
    # written: blocks are read in several stages and must be the same in each
    blocks = text_blocks(rows, TEXT, BLOCK_BYTES, "dedup-blocks")
    buckets = max(1, -(-text_bytes(blocks) // BUCKET_BYTES))
    blocks = blocks.drop("n_bytes")
    copies = written(_copies(written(blocks.mapInArrow(_text_hashes(length), _COPY_ROW), "dedup-hashes")), "dedup-copies")
    found = blocks.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(_anchors(length, anchor, buckets), _ANCHOR_ROW)
    repeated = found.groupBy("bucket").applyInArrow(_repeated, "block long, anchors binary")
    known = repeated.withColumn("places", F.lit(None).cast("array<int>")).unionByName(copies.select("block", F.lit(None).cast("binary").alias("anchors"), "places"))
    units = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_units_of(length, anchor, buckets), _UNIT_ROW)
    back = units.groupBy("bucket").applyInArrow(_resolved(length, buckets), _BACK_ROW)
    binary = F.lit(None).cast("binary")
    back = back.withColumn("places", F.lit(None).cast("array<int>")).unionByName(copies.select("block", binary.alias("own"), binary.alias("least"), binary.alias("news"), "places"))
    schema = ", ".join(f"{o} {'string' if o == own[at] else f.dataType.simpleString()}" for o, f in zip(own, docs.schema.fields, strict=True))
    schema += ", cut struct<n_bytes: bigint, n_removed: bigint, spans: array<struct<start: bigint, stop: bigint>>, kept_sha256: string>"
    cut = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_cut(length, own, at, with_text), schema)
    return cut.toDF(*names, unused(RESULT, names))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    r = F.col(RESULT)
    return found.select("doc_id", r["n_bytes"].alias("n_bytes"), r["n_removed"].alias("n_removed"), F.size(r["spans"]).cast("long").alias("n_spans"), r["kept_sha256"].alias("kept_sha256"))


QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
