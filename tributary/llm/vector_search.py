"""Operator 4, exact top-k by MaxScore over vectors: dimensions are the terms, a query's components their weights.

A component x counts as floor(1024 x); scores are integer inner products. Candidates lie in blocks, term by term: a
term's postings are its components of the block's rows. For a query and a block each term has a highest and a lowest
contribution. Terms are ordered by that range; the non-essential ones are those whose ranges together cannot lift a row
over the query's threshold (its k-th best score so far). Only the postings of essential terms are traversed; the rows
that are still competitive are probed in the other terms, a few at a time, while their bound reaches the threshold.
Each task keeps thresholds across its blocks; the shards' best rows are merged at the end. Bounds are floating-point with
a margin for their rounding; the scores of rows that pass them all are computed in 64-bit integers.

Defined cases: vectors null or with null or non-finite components take no part, nor do rows without an id; a shorter
vector counts as zero in the dimensions that it lacks; rows with the query's own id are never its candidates;
repeated candidate rows are each ranked; ties go to the smaller id; scores beyond 64 bits are not defined; no queries or
no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions, table, written

BLOCK_ROWS = 4096
QUERY_ROWS = 256
#: Blocks of candidates and of queries that a task gets at most, on the average.
SHARD_BLOCKS, GROUP_BLOCKS = 16, 256
PROBE_TERMS = 8
_BLOCK = "part int, ids binary, vecs binary, dim int, width int"


def _blocks(rows_in_block: int):
    """Packs rows into blocks: ids, and components row by row in the fewest bytes that hold them all."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vecs: list[np.ndarray] = []
        held, count = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, vecs, held, count
            dim = max(v.shape[1] for v in vecs)
            x = np.zeros((held, dim), np.int64)
            at = 0
            for v in vecs:
                x[at : at + len(v), : v.shape[1]] = v
                at += len(v)
            most = max(-int(x.min()), int(x.max())) if x.size else 0
            width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1) or w == 8)
            out = pa.RecordBatch.from_arrays([pa.array([count], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([dim], pa.int32()), pa.array([width], pa.int32())], names=["part", "ids", "vecs", "dim", "width"])
            ids, vecs, held, count = [], [], 0, count + 1
            return out

        for b in batches:
            vid, ints = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("ints")
            lens = np.diff(ints.offsets.to_numpy())
            flat = ints.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(lens)])
            for dim in np.unique(lens):
                at = np.flatnonzero(lens == dim)
                x = flat[(start[at][:, None] + np.arange(dim)).reshape(-1)].reshape(len(at), dim)
                done = 0
                while done < len(at):
                    take = min(rows_in_block - held, len(at) - done)
                    ids.append(vid[at[done : done + take]].astype(np.int64))
                    vecs.append(x[done : done + take])
                    held, done = held + take, done + take
                    if held == rows_in_block:
                        yield flush()
        if held:
            yield flush()

    return pack


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = score >= cut
        score, ids = score[near], ids[near]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


class Postings:
    """A block of candidates, term by term."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        self.ids, self.vecs = ids, vecs
        self.terms = np.ascontiguousarray(vecs.T).astype(np.float64)
        self.low, self.high = (self.terms.min(1), self.terms.max(1)) if len(ids) else (np.zeros(vecs.shape[1]), np.zeros(vecs.shape[1]))


def maxscore_block(q: np.ndarray, block: Postings, q_id: int | None, threshold: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of up to k rows of the block, other than q_id's, that reach the threshold (None: all do), by MaxScore."""
    none, weight = np.zeros(0, np.int64), q.astype(np.float64)
    up, down = np.maximum(weight * block.low, weight * block.high), np.minimum(weight * block.low, weight * block.high)
    # what rounding can make of sums of products of this size
    margin = (len(q) + 4) * 2.0**-50 * (np.maximum(np.abs(up), np.abs(down)).sum() + 1)
    least = -np.inf if threshold is None else float(threshold) - margin - abs(float(threshold)) * 2.0**-52
    if up.sum() < least:
        return none, none
    order = np.argsort(down - up, kind="stable")  # the widest range first
    up, down = up[order], down[order]
    # non-essential: with every essential term at its lowest, these together can't lift a row to the threshold
    rest_range = np.concatenate([np.cumsum((up - down)[::-1])[::-1], [0.0]])
    done = max(1, int(np.searchsorted(-(down.sum() + rest_range), -least, side="right")))
    done = min(done, len(order))
    rest_up = np.concatenate([np.cumsum(up[::-1])[::-1], [0.0]])
    terms = order[:done]
    score = weight[terms] @ block.terms[terms]
    at = np.flatnonzero((score + rest_up[done] >= least) & (block.ids != q_id))
    score = score[at]
    while done < len(order) and len(at):
        terms = order[done : done + PROBE_TERMS]
        score = score + weight[terms] @ block.terms[np.ix_(terms, at)]
        done += len(terms)
        alive = score + rest_up[done] >= least
        at, score = at[alive], score[alive]
    exact = block.vecs[at].astype(np.int64) @ q
    if threshold is not None:
        at, exact = at[exact >= threshold], exact[exact >= threshold]
    return _best(exact, block.ids[at], k)


def _unpacked(blocks: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ids, vecs, dim, width in zip(blocks.column("ids"), blocks.column("vecs"), blocks.column("dim").to_pylist(), blocks.column("width").to_pylist(), strict=True):
        i = np.frombuffer(ids.as_buffer(), np.int64)
        yield i, np.frombuffer(vecs.as_buffer(), f"<i{width}").reshape(len(i), dim)


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        """The k best of a shard's candidates for each query of a group."""
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = list(_unpacked(queries))
        for ids, vecs in _unpacked(candidates):
            block = Postings(ids, vecs)
            inside = set(ids.tolist())
            for q_ids, q_vecs in held:
                shared = min(q_vecs.shape[1], vecs.shape[1])
                qs = np.zeros((len(q_ids), vecs.shape[1]), np.int64)
                qs[:, :shared] = q_vecs[:, :shared]
                for q_id, q in zip(q_ids.tolist(), qs, strict=True):
                    s, i = best.get(q_id, (None, None))
                    threshold = int(s[-1]) if s is not None and len(s) == k else None
                    score, found = maxscore_block(q, block, q_id if q_id in inside else None, threshold, k)
                    if len(score):
                        best[q_id] = _best(np.concatenate([s, score]), np.concatenate([i, found]), k) if s is not None else (score, found)
        q_ids = np.repeat(np.fromiter(best, np.int64, len(best)), [len(v[0]) for v in best.values()])
        parts = list(zip(*best.values(), strict=True)) if best else [[np.zeros(0, np.int64)]] * 2
        return pa.table({"query_id": q_ids, "vec_id": np.concatenate(parts[1]), "score": np.concatenate(parts[0])})

    return run


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return rows.filter(x.isNotNull() & F.col(key).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 1024).cast("long")).alias("ints"))


def top_k(rows: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates; queries are the rows where is_query holds.

    Every group of query blocks meets every shard of candidate blocks in a task of its own; both are of bounded size, and
    a block crosses the network once for each group or shard of the other side. Nothing is broadcast.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    ints = quantised(rows, key, vector)
    parts = max(1, shuffle_partitions(spark))
    cand = written(ints.mapInArrow(_blocks(BLOCK_ROWS), _BLOCK), "vector-blocks")
    queries = written(ints.filter(is_query).coalesce(max(1, parts // 8)).mapInArrow(_blocks(QUERY_ROWS), _BLOCK), "vector-queries")
    n_cand, n_query = cand.count(), queries.count()
    shards, groups = max(1, -(-n_cand // SHARD_BLOCKS), min(n_cand, parts)), max(1, -(-n_query // GROUP_BLOCKS))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    q = queries.withColumn("grp", number(groups)).withColumn("shard", numbers(shards))
    c = cand.withColumn("shard", number(shards)).withColumn("grp", numbers(groups))
    best = q.groupBy("grp", "shard").cogroup(c.groupBy("grp", "shard")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


ORACLE_SQL = {
    "op4_maxscore_top_k": """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([a * c.e[i] FOR a, i IN q.e]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
QUERIES = {"op4_maxscore_top_k": op4_maxscore_top_k}
