"""Operator 6, n-gram Jaccard join with rare-first prefix filtering (PPJoin; Xiao et al., 2008 and 2011).

A document is the set of its distinct word n-grams, as 64-bit hashes. Documents of equal sets form a class, told by a
128-bit key and named by its first row, and only classes are compared. A class's n-grams are ordered rarest first, by
the number of documents that have them, ties by hash; two sets whose similarity reaches the threshold share an n-gram
among the first n - ceil(t n) + 1 of each. The prefixes are joined on their n-grams; a pair goes on if the sizes allow it
(length), if what stands behind the shared n-gram can still reach the overlap (positional) and if the sizes of hash
ranges of both sets do (suffix), and is then verified once on the whole sets.

The counts are over all documents and grow with them: blocks of documents send their n-grams, cut to as many bits as tell
the corpus's n-grams apart, to buckets, and learn which of them another document has and how often. Two n-grams that are
alike in these bits count as one, which only makes them look more frequent. An n-gram of one document joins nothing and
is not sent again; most prefixes end there.

A list of many similar classes would give far too many pairs, and classes that links connect need not be compared with
each other for the components' sake. So pairs and lists that pass the filters tie their classes into groups. A group of
bounded size is resolved in one task, where pairs that a link has connected meanwhile are passed over. Larger groups go
through rounds of pivots: a pivot meets its whole list and then leaves it, until the pairs of different components that
remain are few and all are verified. No list is cut and no pair of different components is left out.

Defined cases: a text of fewer words than n has the whole sequence as its one n-gram; null, empty and wordless texts
have none, are linked with nothing and are their own component; rows with equal texts are in one class; a row without a
doc_id takes no part and gets a null component; extra columns are left out; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .blocks import ROWS, from_ipc, from_planes, grouped, planes, run_ends, run_starts, stored, text_blocks, text_bytes
from .common import ascii_words, byte_hashes, coded, discard, give_back, mix64, table, written

#: Entries of an n-gram of more documents do not meet in one task.
HOT = 2000
#: Candidate groups with so many grams in all, 8 bytes each, are resolved in one task; larger ones by further rounds.
GROUP_GRAMS = 2_000_000
#: Pivot rounds go on while the pairs that remain outnumber the list entries by more than this factor; it grows eightfold a round.
PAIRS_PER_ENTRY = 4
#: Bytes of text of a block, and bytes of text whose n-grams, or prefix entries, a bucket gets on the average.
BLOCK_BYTES = 2 << 20
GRAM_BUCKET, ENTRY_BUCKET = 6 << 20, 24 << 20
#: Bits of a counted n-gram beyond those that number the corpus's n-grams; 64 in all at most.
SPARE_BITS = 6
#: Lists of up to so many classes are taken apart into the pairs that pass the filters.
SMALL_LIST = 8
#: Hash ranges whose sizes are compared by the suffix filter, where sets are at hand and in entries; 255 means so many or more.
RANGES, COARSE = 64, 8
#: Up to so many rows, 8 bytes each, are broadcast when blocks are asked for them.
BROADCAST_ROWS = 500_000


def _grams(text: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a large_string array."""
    row, words = ascii_words(pc.ascii_lower(text))
    code, distinct = coded(words)
    w = byte_hashes(distinct)[code] if len(code) else np.zeros(0, np.uint64)
    h = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)])
    size = np.bincount(row, minlength=len(text))
    at = 0
    for s in size.tolist():
        if s >= n:
            x = np.sort(h[at : at + s - n + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif s:
            yield np.array([np.bitwise_xor.reduce(mix64(w[at : at + s] + np.arange(1, s + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))) + np.uint64(s)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
        at += s


def _set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit key of each set, as two signed columns: sums of two mixings of its hashes."""
    out = np.zeros((len(sets), 2), np.uint64)
    size = np.array([len(g) for g in sets], np.int64)
    full = np.flatnonzero(size)
    if len(full):
        h = mix64(np.concatenate([sets[i] for i in full]))
        first = np.cumsum(size[full]) - size[full]
        out[full, 0] = np.add.reduceat(h, first)
        out[full, 1] = np.add.reduceat(mix64(h ^ np.uint64(0x94D049BB133111EB)), first)
    return mix64(out + size.astype(np.uint64)[:, None]).view(np.int64)


def _digest(grams: np.ndarray, parts: int = RANGES) -> np.ndarray:
    """How many grams lie in each of equal ranges of hashes."""
    edges = np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)
    return np.diff(np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]]))


# how many documents have an n-gram

_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<i8"), ("h1", "<i8"), ("h2", "<i8")])
_COUNT = np.dtype([("key", "<u8"), ("n", "<u2")])
_LEVEL = np.dtype([("key", "<u8"), ("level", "u1")])
_DOC_ROW = "row long, doc_id long, n long, h1 long, h2 long"


def _levels(count: np.ndarray) -> np.ndarray:
    """Counts of 2 or more on a scale of 8 steps an octave, from 8; 0 stands for 1."""
    return np.minimum(255, 8 * np.log2(count)).astype(np.uint8)


def key_bits(n_bytes: int) -> int:
    """Bits that tell the n-grams of so many bytes of text apart, with a few to spare."""
    return min(64, max(32, int(n_bytes).bit_length() + SPARE_BITS - 2))


def _bucket(key: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _block_grams(n: int, bits: int, buckets: int):
    """A block's n-grams by bucket, with the number of its sets that have them; and its documents, in buckets of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in stored(batches):
            ids, sets = b.column("doc_id"), list(_grams(b.column("text"), n))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            d = np.empty(len(sets), _DOC)
            d["doc_id"], d["known"] = ids.fill_null(0).to_numpy(zero_copy_only=False), known
            d["n"] = [len(g) for g in sets]
            d["h1"], d["h2"] = _set_keys(sets).T
            one = np.unique(d[["h1", "h2"]][known & (d["n"] > 0)], return_index=True)[1]
            chosen = np.flatnonzero(known & (d["n"] > 0))[one]
            key = np.sort(np.concatenate([sets[i] for i in chosen] or [np.zeros(0, np.uint64)]) >> np.uint64(64 - bits))
            del sets
            first = run_starts(key)
            x = np.empty(len(first), _COUNT)
            x["key"], x["n"] = key[first], run_ends(first, len(key)) - first
            bucket = _bucket(x["key"], bits, buckets)  # ascending with the keys
            lo = run_starts(bucket)
            blobs = [planes(x[i:j]) for i, j in zip(lo, run_ends(lo, len(x)), strict=True)]
            none = [None] * len(blobs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*bucket[lo].tolist(), buckets + (block >> 8) % buckets]), pa.array([block] * (len(blobs) + 1)), pa.array([*blobs, None], pa.binary()), pa.array([*none, planes(d)], pa.binary())],
                names=["bucket", "block", "grams", "docs"],
            )
            give_back()

    return run


def _repeated(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of one bucket, for each block: its n-grams that several documents have, with the level of their count. Documents pass."""
        block = rows.column("block").to_numpy()
        if rows.column("bucket")[0].as_py() >= buckets:
            return pa.table({"block": block, "levels": pa.nulls(len(block), pa.binary()), "docs": rows.column("docs")})
        parts = [from_planes(g.as_py(), _COUNT) for g in rows.column("grams")]
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        x = np.concatenate(parts)
        del parts
        order = np.argsort(x["key"], kind="stable")
        key, owner = x["key"][order], owner[order]
        first = run_starts(key)
        total = np.add.reduceat(x["n"][order].astype(np.int64), first) if len(first) else first
        total = np.repeat(total, run_ends(first, len(key)) - first)
        keep = total > 1
        key, owner, total = key[keep], owner[keep], total[keep]
        out = np.empty(len(key), _LEVEL)
        order, lo, hi = grouped(owner)
        out["key"], out["level"] = key[order], _levels(total[order])
        blobs = [planes(out[i:j]) for i, j in zip(lo, hi, strict=True)]
        blocks = block[owner[order[lo]]] if len(key) else block[:0]
        del x, key, owner, total, out
        give_back()
        return pa.table({"block": blocks, "levels": pa.array(blobs, pa.binary()), "docs": pa.nulls(len(blobs), pa.binary())})

    return run


def _doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, docs in zip(b.column("block").to_pylist(), b.column("docs"), strict=True):
            d = from_planes(docs.as_py(), _DOC)
            cols = [pa.array(block * ROWS + np.arange(len(d))), pa.array(d["doc_id"], mask=d["known"] == 0), *(pa.array(np.ascontiguousarray(d[c])) for c in ("n", "h1", "h2"))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n", "h1", "h2"])


def places_of(rows: DataFrame) -> DataFrame:
    """block and places of row numbers (column row): a block's rows at most."""
    return rows.select(F.floor(F.col("row") / ROWS).cast("long").alias("block"), F.pmod("row", F.lit(ROWS)).cast("int").alias("place")).groupBy("block").agg(F.collect_list("place").alias("places"))


# prefixes


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


#: An entry has its set's coarse digest.
_ENTRY = np.dtype([("gram", "<u8"), ("class", "<i8"), ("size", "<u4"), ("pos", "<u4"), ("hot", "u1"), ("digest", "u1", (COARSE,))])


def _prefixes(n: int, percent: int, bits: int, buckets: int):
    """A block's prefix entries that may meet others, packed by bucket of their gram. Entries of hot grams are spread by class over buckets of their own."""
    hot = int(_levels(np.array([HOT + 1]))[0])

    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        levels = [from_planes(x.as_py(), _LEVEL) for x in back.column("levels") if x.is_valid]
        if not levels or not group.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        known = np.concatenate(levels)
        known = known[np.argsort(known["key"])]
        keys, level = np.ascontiguousarray(known["key"]), np.ascontiguousarray(known["level"])
        block, b = group.column("block")[0].as_py(), from_ipc(group.column("rows")[0])
        skip = ~b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        for x in back.column("places").to_pylist():
            skip[x or []] = True  # copies: their class's first row stands for them
        held = []
        for place, g in enumerate(_grams(b.column("text"), n)):
            if skip[place] or not len(g):
                continue
            key = g >> np.uint64(64 - bits)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            rarity = np.where(keys[at] == key, level[at], 0).astype(np.uint8)
            order = np.argsort(rarity, kind="stable")[: prefix_length(len(g), percent)]  # hashes ascend
            pos = np.flatnonzero(rarity[order])
            if not len(pos):
                continue
            order = order[pos]
            e = np.empty(len(order), _ENTRY)
            e["gram"], e["class"], e["size"], e["pos"], e["hot"] = g[order], block * ROWS + place, len(g), pos, rarity[order] >= hot
            e["digest"] = np.minimum(_digest(g, COARSE), 255)
            held.append(e)
        x = np.concatenate(held) if held else np.empty(0, _ENTRY)
        bucket = np.where(x["hot"] == 1, buckets + x["class"] % buckets, (mix64(x["gram"]) % np.uint64(buckets)).astype(np.int64))
        order, lo, hi = grouped(bucket)
        x, bucket = x[order], bucket[order]
        blobs = [planes(x[i:j]) for i, j in zip(lo, hi, strict=True)]
        give_back()
        return pa.table({"bucket": bucket[lo], "blob": pa.array(blobs, pa.binary())})

    return run


def _distinct(x: np.ndarray) -> np.ndarray:
    """The entries in the order of gram and class, each once."""
    x = x[np.lexsort((x["class"], x["gram"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["gram"][1:] != x["gram"][:-1]) | (x["class"][1:] != x["class"][:-1])
    return x[new]


def _may_link(x: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries i and j of one gram pass the length, positional and (coarse) suffix filters."""
    size, pos = x["size"].astype(np.int64), x["pos"].astype(np.int64)
    need = -(-percent * (size[i] + size[j]) // (100 + percent))
    ok = (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) + np.minimum(pos[i], pos[j]) >= need)
    shared = np.minimum(x["digest"][i], x["digest"][j]).astype(np.int64)
    full = (shared == 255).any(axis=-1)  # both counts may be larger
    return ok & (full | (shared.sum(axis=-1) >= need))


def _sublists(x: np.ndarray, percent: int) -> np.ndarray:
    """Labels of one list's entries: those that pairs passing the filters tie together have one label; -1 for entries without such a pair."""
    order = np.argsort(x["size"], kind="stable")
    y = x[order]
    label = np.arange(len(y))
    alone = np.ones(len(y), bool)
    last = np.searchsorted(y["size"], 100 * y["size"].astype(np.int64) // percent, side="right")
    for i in range(len(y)):
        j = np.arange(i + 1, last[i])
        j = j[_may_link(y, np.full(len(j), i), j, percent)] if len(j) else j
        if len(j):
            alone[i] = alone[j] = False
            old = np.unique(np.append(label[j], label[i]))
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    out = np.empty(len(x), np.int64)
    out[order] = np.where(alone, -1, label)
    return out


def _in_bands(x: np.ndarray, percent: int) -> np.ndarray:
    """Entries of hot grams in bands of sizes: two sizes that the threshold allows share a band. Every entry is in two."""
    width = np.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-9
    band = np.floor(np.log(x["size"]) / width).astype(np.int64).astype(np.uint64)
    parts = []
    for k in (0, 1):
        y = x.copy()
        y["gram"] = mix64(y["gram"] ^ mix64(band + np.uint64(k)))
        parts.append(y)
    return np.concatenate(parts)


def _shared(percent: int, buckets: int):
    """Of one bucket: lists of classes that pairs passing the filters tie together.

    A list of up to SMALL_LIST classes gives each passing pair as a list of its own, which is the same whatever grams the
    pair shares, with positions of 0, which pass whatever the sizes allow. A longer list is taken apart where no passing
    pair ties its entries.
    """

    def run(blobs: pa.Table) -> pa.Table:
        x = _distinct(np.concatenate([from_planes(b.as_py(), _ENTRY) for b in blobs.column("blob")]))
        if blobs.column("bucket")[0].as_py() >= buckets:
            return _rows(_in_bands(x, percent))
        first = run_starts(x["gram"])
        sizes = np.diff(np.append(first, len(x)))
        count = np.repeat(sizes, sizes)
        long_ = [x[f : f + n] for f, n in zip(first.tolist(), sizes.tolist(), strict=True) if n > SMALL_LIST]
        parts = []
        for y in long_:
            label = _sublists(y, percent)
            y = y.copy()
            y["gram"] = mix64(y["gram"] + label.astype(np.uint64))
            parts.append(y[label >= 0])
        x = x[(count > 1) & (count <= SMALL_LIST)]
        for d in range(1, min(SMALL_LIST, len(x))):  # entries are in the order of gram and class
            i = np.flatnonzero(x["gram"][d:] == x["gram"][:-d])
            i = i[_may_link(x, i, i + d, percent)]
            both = np.stack([x[i], x[i + d]])
            both["gram"] = mix64(mix64(x["class"][i].view(np.uint64)) + x["class"][i + d].view(np.uint64))
            both["pos"] = 0  # the filter has been passed; positions of other shared grams must not meet in it
            parts.append(both.reshape(-1))
        e = _distinct(np.concatenate(parts)) if parts else x[:0]
        give_back()
        return _rows(e)

    return run


def _rows(e: np.ndarray) -> pa.Table:
    digest = np.ascontiguousarray(e["digest"]).view("<i8").reshape(-1)
    return pa.table({"gram": np.ascontiguousarray(e["gram"]).view(np.int64), "class": np.ascontiguousarray(e["class"]), "size": e["size"].astype(np.int64), "pos": e["pos"].astype(np.int64), "digest": digest})


# whole sets


def _verifier(percent: int):
    """Pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                left, right = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                need = -(-percent * (len(left) + len(right)) // (100 + percent))
                both = np.sort(np.concatenate([left, right]))
                good.append(int((both[1:] == both[:-1]).sum()) >= need)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return run


def _resolver(percent: int):
    """Links that connect the components of one bounded group of classes; pairs already connected are not tested."""

    def run(entries: pa.Table, sets: pa.Table) -> pa.Table:
        known = {c: np.frombuffer(g.as_buffer(), np.uint64) for c, g in zip(sets.column("class").to_pylist(), sets.column("grams"), strict=True)}
        found: list[tuple[int, int]] = []
        ids, at = np.unique(entries.column("class").to_numpy(), return_inverse=True)
        lists, of = np.unique(entries.column("gram").to_numpy(), return_inverse=True)
        comp = np.zeros(len(ids), np.int64)
        comp[at] = entries.column("comp").to_numpy()
        grams = [known[c] for c in ids.tolist()]
        digest = np.array([_digest(g) for g in grams]).reshape(len(ids), RANGES)
        size = digest.sum(axis=1)
        by_list = np.argsort(of, kind="stable")
        members = np.split(at[by_list], np.cumsum(np.bincount(of, minlength=len(lists)))[:-1])
        by_class = np.split(of[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at, minlength=len(ids)))[:-1])
        for x in range(len(ids)):
            near = np.zeros(len(ids), bool)
            for g in by_class[x].tolist():
                near[members[g]] = True
            near[: x + 1] = False
            y = np.flatnonzero(near & (comp != comp[x]))
            low, high = np.minimum(size[y], size[x]), np.maximum(size[y], size[x])
            y = y[100 * low >= percent * high]
            need = -(-percent * (size[y] + size[x]) // (100 + percent))
            fits = np.minimum(digest[y], digest[x]).sum(axis=1) >= need
            for z, least in zip(y[fits].tolist(), need[fits].tolist(), strict=True):
                if comp[z] == comp[x]:
                    continue
                both = np.sort(np.concatenate([grams[x], grams[z]]))
                if int((both[1:] == both[:-1]).sum()) >= least:
                    found.append((int(ids[x]), int(ids[z])))
                    comp[comp == comp[z]] = comp[x]
        give_back()
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


class _Join:
    """Blocks of documents, and how their sets are compared."""

    def __init__(self, blocks: DataFrame, n: int, percent: int):
        self.blocks, self.n, self.percent = blocks, n, percent
        self.spark = blocks.sparkSession

    def entries(self, levels: DataFrame, copies: DataFrame, bits: int, n_bytes: int) -> DataFrame:
        """Lists of classes that may be linked: gram, class, size, position and digest. One pair or part of a list comes once."""
        buckets = max(1, -(-n_bytes // ENTRY_BUCKET))
        back = levels.withColumn("places", F.lit(None).cast("array<int>")).unionByName(places_of(copies).withColumn("levels", F.lit(None).cast("binary")))
        packed = self.blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_prefixes(self.n, self.percent, bits, buckets), "bucket long, blob binary")
        shared = packed.groupBy("bucket").applyInArrow(_shared(self.percent, buckets), "gram long, class long, size long, pos long, digest long")
        return shared.dropDuplicates(["gram", "class"])

    def sets(self, classes: DataFrame) -> DataFrame:
        """class and set of the (distinct) classes."""
        n = self.n
        wanted = places_of(classes.select(F.col("class").alias("row")))
        few = classes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, rows, places in zip(b.column("block").to_pylist(), b.column("rows"), b.column("places"), strict=True):
                    place = np.sort(places.values.to_numpy()).astype(np.int64)
                    grams = [g.tobytes() for g in _grams(from_ipc(rows).column("text").take(pa.array(place)), n)]
                    yield pa.RecordBatch.from_arrays([pa.array(block * ROWS + place), pa.array(grams, pa.binary())], names=["class", "grams"])
                    give_back()

        return self.blocks.join(F.broadcast(wanted) if few else wanted, "block").select("block", "rows", "places").mapInArrow(run, "class long, grams binary")

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs a < b of classes that pass the length, positional and (coarse) suffix filters; pairs has sizes, positions and digests of both."""
        p = self.percent
        low, high = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
        rest = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))  # the shared gram and what follows it
        before = F.least("pos_a", "pos_b")  # at most so many shared ones stand before it
        need = F.ceil(F.lit(p) * (F.col("size_a") + F.col("size_b")) / F.lit(100 + p))
        at: list[Column] = [F.least(*(F.shiftright(F.col(f"digest_{side}"), 8 * k).bitwiseAND(F.lit(255)) for side in "ab")) for k in range(COARSE)]
        full = F.array_contains(F.array(*at), F.lit(255).cast("long"))
        ok = (F.lit(100) * low >= F.lit(p) * high) & (rest + before >= need) & (full | (sum(at, F.lit(0)) >= need))
        return pairs.filter(ok).select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).filter("a < b").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs of classes that reach the threshold."""
        sets = written(self.sets(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()), "gram-sets")
        left = pairs.join(sets.select(F.col("class").alias("b"), F.col("grams").alias("set_b")), "b")
        both = left.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("set_a")), "a")
        found = written(both.select("a", "b", "set_a", "set_b").mapInArrow(_verifier(self.percent), "a long, b long"), "gram-links")
        discard(sets)
        return found


_OF_LIST = ("class", "size", "pos", "digest")


def _components(links: DataFrame) -> DataFrame:
    return written(components(links), "gram-components").select(F.col("node").alias("class"), F.col("component").alias("comp"))


def class_components(join: _Join, entries: DataFrame) -> DataFrame:
    """class and component (comp, one of its classes) of the classes that have links."""
    factor = PAIRS_PER_ENTRY
    none = join.spark.createDataFrame([], "a long, b long")
    links, tried, comp = none, none, none.select(F.col("a").alias("class"), F.col("b").alias("comp"))
    while not entries.isEmpty():
        at = entries.join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        # a list whose classes are one component is settled
        of_comp = at.groupBy("gram", "comp").agg(F.min(F.struct(*_OF_LIST)).alias("m"), F.count(F.lit(1)).alias("c"))
        one = F.struct("comp", "m")
        lists = of_comp.groupBy("gram").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q")).filter("lo.comp <> hi.comp")
        # lists that are still open: groups of classes tied by them, and the bounded groups at once
        open_ = written(at.join(lists.select("gram"), "gram"), "gram-open")
        tied = components(open_.select(F.col("class").alias("a"), F.xxhash64("gram").alias("b"))).select(F.col("node").alias("class"), F.col("component").alias("grp"))
        grouped_ = written(open_.join(tied, "class"), "gram-groups")
        weight = written(grouped_.select("grp", "class", "size").distinct().groupBy("grp").agg(F.sum("size").alias("grams")), "gram-weights")
        small = grouped_.join(weight.filter(F.col("grams") <= GROUP_GRAMS).select("grp"), "grp")
        of_group = written(small.select("grp", "class").distinct(), "gram-classes")
        sets = join.sets(of_group.select("class")).join(of_group, "class").select("grp", "class", "grams")
        found = small.select("grp", "gram", "class", "comp").groupBy("grp").cogroup(sets.groupBy("grp")).applyInArrow(_resolver(join.percent), "a long, b long")
        links = links.unionByName(written(found, "gram-links"))
        rest = written(grouped_.join(weight.filter(F.col("grams") > GROUP_GRAMS).select("grp"), "grp", "left_semi").select("gram", *_OF_LIST, "comp"), "gram-entries")
        if rest.isEmpty():
            discard(entries, open_, grouped_, weight, of_group, rest)
            return _components(links)
        at, lists = rest, written(lists.join(rest.select("gram").distinct(), "gram", "left_semi"), "gram-lists")
        discard(entries, open_, grouped_, weight, of_group)
        entries = rest.drop("comp")
        t = lists.agg(F.sum("n").alias("entries"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2).alias("pairs")).first()
        few = t["pairs"] <= factor * t["entries"]
        if few:
            x = at.select("gram", *(F.col(c).alias(f"{c}_a") for c in (*_OF_LIST, "comp")))
            y = at.select("gram", *(F.col(c).alias(f"{c}_b") for c in (*_OF_LIST, "comp")))
            pairs = x.join(y, "gram").filter("comp_a < comp_b")
        else:
            ends = lists.select("gram", F.explode(F.array("lo", "hi")).alias("p")).select("gram", F.col("p.comp").alias("comp_a"), *(F.col(f"p.m.{c}").alias(f"{c}_a") for c in _OF_LIST))
            pairs = at.select("gram", *(F.col(c).alias(f"{c}_b") for c in (*_OF_LIST, "comp"))).join(ends, "gram").filter("comp_a <> comp_b")
        pairs = written(join.passing(pairs).join(tried, ["a", "b"], "left_anti"), "gram-pairs")
        tried = tried.unionByName(pairs)
        links = links.unionByName(join.links(pairs))
        comp = _components(links)
        if few:
            break
        # pivots have met all their lists' classes of other components: they leave
        gone = lists.select("gram", F.explode(F.array("lo.m.class", "hi.m.class")).alias("class"))
        entries = written(entries.join(gone, ["gram", "class"], "left_anti"), "gram-entries")
        discard(rest, lists)
        factor *= 8  # lists of unlike classes gain little from pivots: their pairs are met directly the sooner
    return comp


def row_components(blocks: DataFrame, n: int, percent: int) -> DataFrame:
    """row (number), doc_id, n (size of the set) and component_id of every row of the blocks, and first: whether it is the component's first row."""
    n_bytes = text_bytes(blocks)
    bits, buckets = key_bits(n_bytes), max(1, -(-n_bytes // GRAM_BUCKET))
    packed = blocks.select("block", "rows").mapInArrow(_block_grams(n, bits, buckets), "bucket long, block long, grams binary, docs binary")
    counted = written(packed.groupBy("bucket").applyInArrow(_repeated(buckets), "block long, levels binary, docs binary"), "gram-counts")
    docs = written(counted.filter("docs IS NOT NULL").select("block", "docs").mapInArrow(_doc_rows, _DOC_ROW), "gram-docs")
    part = docs.filter("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "row"))
    several = written(part.groupBy("h1", "h2").agg(F.min("row").alias("class"), first.alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "gram-several")
    few = several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # a class's rows, for classes of several; another row's class is itself
    copies = written(part.join(F.broadcast(several) if few else several, ["h1", "h2"]).select("row", "class", F.col("f.doc_id").alias("least"), F.col("f.row").alias("of")), "gram-copies")
    join = _Join(blocks, n, percent)
    levels = counted.filter("levels IS NOT NULL").select("block", "levels")
    entries = written(join.entries(levels, copies.filter("row <> class").select("row"), bits, n_bytes), "gram-entries")
    comp = class_components(join, entries)
    own = F.struct("least", "of")
    of_class = comp.join(copies.filter("row = class").select("class", "least", "of"), "class", "left").join(docs.select(F.col("row").alias("class"), F.col("doc_id").alias("d")), "class")
    of_class = of_class.select("class", "comp", F.coalesce("least", "d").alias("least"), F.coalesce("of", "class").alias("of"))
    least = of_class.groupBy("comp").agg(F.min(own).alias("m"))
    of_class = written(of_class.select("class", "comp").join(least, "comp").select("class", "m"), "gram-component-ids")
    discard(counted, several)
    rows = docs.join(copies, "row", "left").withColumns({"class": F.coalesce("class", "row"), "alone": F.struct(F.coalesce("least", "doc_id").alias("least"), F.coalesce("of", "row").alias("of"))})
    rows = rows.join(of_class, "class", "left").withColumn("m", F.coalesce("m", "alone"))
    part = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return rows.select("row", "doc_id", "n", F.when(part, F.col("m.least")).otherwise(F.col("doc_id")).alias("component_id"), (~part | (F.col("m.of") == F.col("row"))).alias("first"))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def jaccard_components(docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    blocks = text_blocks(_texts(docs, key, text), "text", BLOCK_BYTES, "gram-blocks")
    return row_components(blocks, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def first_of_components(docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each component: that with the least doc_id. Rows without a doc_id or words all stay."""
    names, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = names.index(text)
    # beside the two columns that the blocks need stand the rows' own, which may have any name; the text only once
    rest = [F.col(f"`{c}`").alias(o) if i != at else F.col(f"`{c}`").isNull().alias(o) for i, (c, o) in enumerate(zip(names, own, strict=True))]
    packed = docs.select(*rest, F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks = text_blocks(packed, "text", BLOCK_BYTES, "gram-blocks")
    found = row_components(blocks, n, percent)
    gone = written(found.filter("NOT first").select("row"), "gram-gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    places = places_of(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, out in zip(b.column("rows"), b.column("places").to_pylist(), strict=True):
                x = from_ipc(rows)
                keep = np.ones(x.num_rows, bool)
                keep[out or []] = False
                texts = pc.if_else(x.column(own[at]), pa.scalar(None, pa.large_string()), x.column("text")).cast(pa.string())
                yield x.select(own).set_column(at, own[at], texts).filter(pa.array(keep))

    kept = blocks.join(F.broadcast(places) if few else places, "block", "left").select("rows", "places")
    schema = ", ".join(f"c{i} {'string' if i == at else f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return kept.mapInArrow(run, schema).toDF(*names)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
