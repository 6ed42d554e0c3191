"""Operator 2, host-level quality rules: rule failures by host, shrunk by an empirical beta prior, joined back.

Each document is measured and held against fixed rules. The failures of a host's documents give its rate, and the
rates of all hosts give a beta prior (method of moments on the between-host variance), which pulls the rates of
hosts with few documents towards the corpus mean. A host whose shrunk rate passes `max_host_rate` is rejected with
all its documents; elsewhere a document goes if it breaks a rule itself.

Defined cases: a null text has no words (and so fails the length rule); a null host is a host of its own; repeated
rows are judged row by row and each counts for its host; extra columns are left out; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, bounded_batches, coded, table, text_slices, unused, written

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Hosts up to this number are broadcast; beyond it the verdicts come by a shuffled join.
BROADCAST_HOSTS = 100_000


@dataclass(frozen=True)
class Rules:
    """Thresholds; a document breaks a rule when a measure passes them."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.3
    max_dup_line_share: float = 0.5
    min_dup_lines: int = 3
    max_host_rate: float = 0.8


def _sum_by(row: np.ndarray, value: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(row, value, n).astype(np.int64)


def _repeat_words(row: np.ndarray, words: pa.Array, n: int) -> np.ndarray:
    """Words of each text in 3-word windows that the text has twice or more."""
    out = np.zeros(n, np.int64)
    if len(row) < 3:
        return out
    code, distinct = coded(words)
    if len(distinct) >= 1 << 21:  # three codes don't fit 63 bits: code the pairs first
        pair = np.unique((code[:-2] << 31) | code[1:-1], return_inverse=True)[1].astype(np.int64)
        key = (pair << 31) | code[2:]
    else:
        key = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
    at = np.flatnonzero(row[:-2] == row[2:])
    key = key[at]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), bool)
    often[1:] |= same
    often[:-1] |= same
    at, key = at[order[often]], key[order[often]]  # windows that the whole slice has more than once
    if not len(at):
        return out
    doc = row[at]
    order = np.lexsort((doc, key))
    at, key, doc = at[order], key[order], doc[order]
    same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    often = np.zeros(len(key), bool)
    often[1:] |= same
    often[:-1] |= same
    at = at[often]
    covered = np.zeros(len(row), bool)
    for k in range(3):
        covered[at + k] = True
    return _sum_by(row[covered], None, n)


def text_measures(text: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text of a large_string array without nulls."""
    n = len(text)
    row, words = ascii_words(text)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    raw = text.cast(pa.large_binary())
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
    marks = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
    lines = pc.split_pattern(text, "\n")
    line, offsets = lines.flatten(), lines.offsets.to_numpy()
    line_row = np.repeat(np.arange(n), np.diff(offsets))
    worded = pc.binary_length(pc.ascii_trim_whitespace(line)).to_numpy(zero_copy_only=False) > 0
    code, distinct = coded(line)
    key = line_row[worded] * max(1, len(distinct)) + code[worded]
    first = np.unique(key, return_index=True)[1]
    dup = np.ones(len(key), bool)
    dup[first] = False
    return {
        "n_words": _sum_by(row, None, n),
        "word_chars": _sum_by(row, chars, n),
        "n_symbols": marks[off[1:] - off[0]] - marks[off[:-1] - off[0]],
        "n_lines": _sum_by(line_row[worded], None, n),
        "n_dup_lines": _sum_by(line_row[worded][dup], None, n),
        "n_repeat_words": _repeat_words(row, words, n),
    }


def measured(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, host and MEASURES of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = text_measures(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=["doc_id", "host", *MEASURES])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(measure, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def broken_rules(rules: Rules, prefix: str = "") -> dict[str, F.Column]:
    """Conditions on the columns of MEASURES, by the rule's name."""
    m = {name: F.col(prefix + name) for name in MEASURES}
    return {
        "too_short": m["n_words"] < rules.min_words,
        "repeats": F.lit(100) * m["n_repeat_words"] > F.lit(rules.max_repeat_percent) * m["n_words"],
        "symbols": m["n_symbols"] > F.lit(rules.max_symbols_per_word) * F.greatest(m["n_words"], F.lit(1)),
        "dup_lines": (m["n_dup_lines"] >= rules.min_dup_lines) & (m["n_dup_lines"] > F.lit(rules.max_dup_line_share) * m["n_lines"]),
    }


def host_verdicts(rows: DataFrame, max_host_rate: float) -> DataFrame:
    """host, n_docs, n_failed, host_rate (posterior mean) and host_rejected, from rows with host and failed.

    The prior is Beta(m * s, (1 - m) * s): m is the corpus rate; s follows from the variance of host rates that
    binomial noise does not explain. Where noise explains it all, s is the corpus size and all hosts get the mean.
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    t = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2"), F.sum(F.col("n_docs") * rate * rate).alias("w")).first()
    n, f = int(t["n"] or 0), int(t["f"] or 0)
    m = f / n if n else 0.0
    # weighted between-host variance: E[sum n (r - m)^2] = (k - 1) m (1 - m) + v (n - n2 / n), v being m (1 - m) / (s + 1)
    spread = float(t["w"] or 0) - n * m * m
    free = n - int(t["n2"] or 0) / n if n else 0.0
    noise = m * (1 - m)
    v = (spread - (t["hosts"] - 1) * noise) / free if free > 0 else 0.0
    s = min(float(max(n, 1)), max(1e-3, noise / v - 1)) if v > 0 else float(max(n, 1))
    post = (F.col("n_failed") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s))
    return hosts.withColumn("host_rate", post).withColumn("host_rejected", post > max_host_rate)


def apply_quality_rules(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Per row: doc_id, host, MEASURES, base_failed, failed_rules, host_rate, host_rejected and kept."""
    broken = broken_rules(rules)
    rows = written(measured(docs, key, host, text), "quality-measures").withColumns(
        {
            "base_failed": broken["too_short"] | broken["repeats"],
            "failed_rules": F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in broken.items()))),
        }
    )
    rows = rows.withColumn("failed", F.size("failed_rules") > 0)
    hosts = written(host_verdicts(rows, rules.max_host_rate), "quality-hosts")
    verdicts = hosts.select(F.col("host").alias("of_host"), "host_rate", "host_rejected")
    # the host table can be as large as the web; it is broadcast only when its counted size is small
    small = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(verdicts) if small else verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.withColumn("kept", ~F.col("failed") & ~F.col("host_rejected")).drop("of_host", "failed")


def kept_rows(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """The rows that the rules keep, with their own columns. Texts are measured again where they lie instead of being joined with verdicts."""
    broken = broken_rules(rules)
    failed = F.lit(False)
    for c in broken.values():
        failed = failed | c
    rows = written(measured(docs, key, host, text).withColumn("failed", failed).select("host", "failed"), "quality-failures")
    hosts = written(host_verdicts(rows, rules.max_host_rate), "quality-hosts").filter("host_rejected").select(F.col("host").alias("__host"))
    of_host, measures = unused("__host", docs.columns), unused("__measures", docs.columns)
    hosts = hosts.withColumnRenamed("__host", of_host)

    def measure(t: pa.Array) -> pa.Array:
        parts = []
        for b in text_slices(iter([pa.RecordBatch.from_arrays([t], names=["text"])])):
            found = text_measures(b.column("text"))
            parts.append(pa.StructArray.from_arrays([pa.array(found[m], pa.int64()) for m in MEASURES], list(MEASURES)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(m, pa.int64()) for m in MEASURES]))

    bounded_batches(docs.sparkSession)
    of_text = F.arrow_udf(measure, ", ".join(f"{m} long" for m in MEASURES))
    with_measures = docs.withColumn(measures, of_text(F.col(text).cast("string")))
    for name, c in broken_rules(rules, f"{measures}.").items():
        with_measures = with_measures.filter(~c)
    small = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    kept = with_measures.join(F.broadcast(hosts) if small else hosts, F.col(host).cast("string").eqNullSafe(F.col(of_host)), "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", F.concat_ws(",", "failed_rules").alias("failed_rules"), "host_rate")


QUERIES = {"op2_host_quality_rules": op2_host_quality_rules}
