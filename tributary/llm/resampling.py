"""Operator 13, importance resampling towards a target corpus by hashed n-gram features (Xie and others, 2023).

A batch's words become ids in one array, and the places of the array are sorted by the words that follow, up to the
longest n-gram and the document's end: a suffix array. Neighbours' common prefixes (LCP) cut it into runs: for each n, a
run of suffixes that share n words is one repeated n-gram with all its occurrences. Its text is hashed once a run, and the
bucket goes back to the occurrences by their places. One pass counts the buckets of the raw and of the target texts (each
partition sends a row for each bucket); a second pass over the raw texts adds up the gains of each document's features. The
gains are one number for each of `buckets` buckets, whatever the corpus. A document's noise follows from its id and the
seed. Ranks come from a range partition by score of narrow rows: places in a part, and the parts' sizes.

Defined cases: a null or empty text has no features and weight 0, and it is not eligible unless `min_words` is 0; a null
doc_id draws the noise of an empty id and comes last of its score; rows with the same doc_id are ranked each for itself,
those alike in score too by the number of features; without target texts all t are 0; extra columns are left out; no rows
give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import run_starts
from .common import bounded_batches, coded, shuffle_partitions, table, text_slices, written

SLICE_BYTES = 4 << 20
#: Bytes of words: digits, letters a to z, and all that is not ASCII.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Rows of a part are told from its number in monotonically_increasing_id by this many bits.
_PLACE_BITS = 33


@dataclass(frozen=True)
class Settings:
    n_min: int = 1
    n_max: int = 1
    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10
    min_words: int = 20


def word_ids(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of a large_string array without nulls: where each text's words begin (and the end), the words' ids, the distinct words."""
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = _LOWER[np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]]
    off = off - off[0]
    inside = _IN_WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begin = off[:-1][np.diff(off) > 0]  # a word does not go on into the next text
    starts[begin] = inside[begin]
    first = np.flatnonzero(starts)
    at = np.append(np.cumsum(inside) - inside, inside.sum())
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(at[first], at[-1]).astype(np.int64)), pa.py_buffer(data[inside])])
    code, distinct = coded(words)
    return np.searchsorted(first, off), code, distinct.to_pylist()


def suffix_array(code: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the `depth` words from there, no more than are `left` in the document, and how many words each has in common with the one before."""
    words = [np.where(left > k, np.append(code[k:], np.full(min(k, len(code)), -1)), -1) for k in range(depth)]
    order = np.lexsort(words[::-1])
    lcp, same = np.zeros(len(code), np.int64), np.ones(max(0, len(code) - 1), bool)
    for w in words:
        w = w[order]
        same &= (w[1:] == w[:-1]) & (w[1:] >= 0)
        lcp[1:] += same
    return order, lcp


def features(text: pa.Array, s: Settings) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; for each n its occurrences in ascending order: the text's number and the feature's bucket."""
    off, code, distinct = word_ids(text)
    doc = np.repeat(np.arange(len(text)), np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(code))
    order, lcp = suffix_array(code, left, s.n_max)
    out = []
    for n in range(s.n_min, s.n_max + 1):
        whole = left[order] >= n
        place, run = order[whole], np.cumsum((lcp < n)[whole]) - 1
        first = place[run_starts(run)]
        grams = zip(*(code[first + k].tolist() for k in range(n)))
        bucket = np.fromiter((zlib.crc32(b" ".join([distinct[c] for c in g])) % s.buckets for g in grams), np.int64, len(first))
        at = np.full(len(code), -1)
        at[place] = bucket[run]
        out.append((doc[at >= 0], at[at >= 0]))
    return np.diff(off), out


def bucket_counts(texts: DataFrame, s: Settings, text: str = "text") -> np.ndarray:
    """Features of all rows in each bucket: a row for each of the buckets comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for b in text_slices(batches, limit=SLICE_BYTES):
            for _, bucket in features(b.column("text"), s)[1]:
                total += np.bincount(bucket, minlength=s.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    bounded_batches(texts.sparkSession)
    found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(s.buckets, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the target's smoothed share of each bucket over the raw texts', rounded down."""
    of_raw, of_target = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_raw / ((n + 1.0) * of_target))) for n, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, s: Settings, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row, and its columns `keep` as k0, k1, ..."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, limit=SLICE_BYTES):
            n_words, found = features(b.column("text"), s)
            n, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for doc, bucket in found:
                n += np.bincount(doc, minlength=b.num_rows)
                total = np.concatenate([[0], np.cumsum(shared.value[bucket])])
                weight += np.diff(total[np.searchsorted(doc, np.arange(b.num_rows + 1))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(weight), *(b.column(c) for c in kept)], names=["doc_id", "n_words", "n_features", "weight", *kept])

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_features long, weight long" + "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in kept)
    text_id = F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text_id, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")
    return rows.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise)



def ranked(scores: DataFrame, s: Settings) -> DataFrame:
    """The rows of `weighed`, written, with rank: 1, 2, 3 ... of the drawn percent of the eligible rows, else null."""
    scores = written(scores.withColumn("spread", F.monotonically_increasing_id()), "importance-scores")
    eligible = F.col("n_words") >= s.min_words
    # rows with one doc_id and score may be many: spread tells them apart
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("spread")]
    parts = max(1, shuffle_partitions(scores.sparkSession))
    sorted_ = scores.filter(eligible).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_ = written(sorted_.withColumn("at", F.monotonically_increasing_id()), "importance-ranks")
    part = F.shiftright("at", _PLACE_BITS)
    before, rows = 0, []
    for r in sorted_.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each part
        rows.append((r["part"], before))
        before += r["count"]
    starts = scores.sparkSession.createDataFrame(rows, "part long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    drawn = s.percent * before // 100
    placed = sorted_.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "start", "at")
    return placed.unionByName(scores.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))).drop("spread")


def importance_ranks(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row."""
    gain = gains(bucket_counts(docs, settings, text), bucket_counts(target, settings, target_text))
    return ranked(weighed(docs, gain, settings, key, text), settings).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """The drawn rows of docs, all columns. Texts are not shuffled: the last rank's score and id say which rows are drawn, and rows alike in both are drawn together."""
    gain = gains(bucket_counts(docs, settings, text), bucket_counts(target, settings, target_text))
    last = ranked(weighed(docs, gain, settings, key, text), settings).filter("rank IS NOT NULL").orderBy(F.col("rank").desc()).select("score", "doc_id").first()
    rows = weighed(docs, gain, settings, key, text, tuple(docs.columns))
    if last is None:
        chosen = F.lit(False)
    else:
        tie = F.col("doc_id") <= last["doc_id"] if last["doc_id"] is not None else F.lit(True)
        chosen = (F.col("n_words") >= settings.min_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & F.coalesce(tie, F.lit(False))))
    return rows.filter(chosen).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc_table() -> str:
    rows = range(256)
    for _ in range(8):
        rows = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in rows]
    return str(list(rows))


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word"
_S = Settings()
QUERIES = {"op13_importance_resampling": op13_importance_resampling}
ORACLE_SQL = {
    "op13_importance_resampling": f"""
WITH d AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {_WORDS} FROM documents) GROUP BY ALL),
t AS (SELECT word, count(*) AS n FROM (SELECT {_WORDS} FROM benchmark) GROUP BY ALL),
x AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM d UNION SELECT word FROM t)),
y AS (SELECT word, list_transform(range(1, length(hx), 2), lambda i: CAST('0x' || substr(hx, i, 2) AS BIGINT)) AS bytes FROM x),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, z: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, z) & 255) + 1])), 4294967295) % {_S.buckets} AS bucket FROM y),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM d JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, sum(n)::DOUBLE AS t FROM t JOIN b USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + {_S.buckets}) / ((s + 1) * (coalesce((SELECT sum(t) FROM g), 0) + {_S.buckets}))))::BIGINT AS gain FROM s LEFT JOIN g USING (bucket)),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM d JOIN b USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
z AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{_S.seed}:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN w USING (doc_id)),
v AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= {_S.min_words} AS ok FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id) AS rank, (SELECT {_S.percent} * count(*) // 100 FROM v WHERE ok) AS most FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND rank <= most THEN rank END AS rank FROM r"""
}
