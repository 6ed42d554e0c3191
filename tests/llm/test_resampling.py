"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import resampling
from tributary.llm.resampling import Settings

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(rows, target, s):
    def buckets(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % s.buckets for n in range(s.n_min, s.n_max + 1) for i in range(len(w) - n + 1)]

    raw, aim = Counter(b for _, t in rows for b in buckets(t)), Counter(b for t in target for b in buckets(t))
    of_raw, of_aim = sum(raw.values()) + s.buckets, sum(aim.values()) + s.buckets
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * of_raw / ((raw[b] + 1) * of_aim))) for b in raw}
    out = []
    for i, t in rows:
        found = buckets(t)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ok = [k for k, (_, t) in enumerate(rows) if len(words(t)) >= s.min_words]
    for place, k in enumerate(sorted(ok, key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, out[k][1]))[: s.percent * len(ok) // 100]):
        out[k][4] = place + 1
    return [tuple(x) for x in out]


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    pool = ["the", "THE", "river", "Été", "été", "naïve", "x1", "42", "中文", "under_score", "tab\tword", "a\x7fb", "nb sp", "İ"] + [f"w{i}" for i in range(100)]
    out = [(int(i), " ".join(rng.choice(pool, rng.integers(0, 60)))) for i in range(200)]
    out += [(500, None), (501, ""), (502, "..."), (503, "long " * 50_000), (504, "x" * 300_000), (None, "a b c " * 10), (None, None), (3, out[3][1]), (3, "quite another text " * 9)]
    return out + [(7, "hot copy of one row with one id " * 4)] * 60


TARGET = ["the river w1 w2 w3 Été", "w1 w2", None, ""]


@pytest.mark.parametrize("s", [Settings(), Settings(1, 3, 97, 5, 30, 5), Settings(2, 2, 1000, 1, 100, 0), Settings(percent=0)])
@pytest.mark.parametrize("size", [4 << 20, 800])
def test_ranks(spark, rows, s, size, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", size)
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, weight string, rank int").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.importance_ranks(docs, target, s)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows, TARGET, s), key=key)


def test_drawn_rows(spark, rows):
    once = [r for i, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:i]}]
    docs = spark.createDataFrame([(*r, "c", i) for i, r in enumerate(once)], "doc_id long, text string, score string, k0 int").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resample(docs, target)
    want = {x[0] for x in by_hand(once, TARGET, Settings()) if x[4] is not None}
    assert got.schema == docs.schema and {r.doc_id for r in got.collect()} == want and got.count() == len(want)
    assert resampling.resample(docs.limit(0), target).count() == 0 and resampling.importance_ranks(docs.limit(0), target.limit(0)).count() == 0
    assert resampling.importance_ranks(docs, target.limit(0)).count() == len(once)


def test_runs():
    """Suffixes are in order, and every n-gram is one run with all its occurrences."""
    texts = ["a b a b c", "", "b c a b", "a", "a b a b c d"]
    off, code, distinct = resampling.word_ids(pa.array(texts, pa.large_string()))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(code))
    order, lcp = resampling.suffix_array(code, left, 3)
    suffix = [tuple(code[i : i + min(3, n)].tolist()) for i, n in zip(range(len(code)), left)]
    assert [suffix[i] for i in order] == sorted(suffix)
    assert all(n == next((k for k, (x, y) in enumerate(zip(suffix[i], suffix[j])) if x != y), min(len(suffix[i]), len(suffix[j]))) for i, j, n in zip(order, order[1:], lcp[1:]))
    n_words, found = resampling.features(pa.array(texts, pa.large_string()), Settings(1, 3))
    assert n_words.tolist() == [5, 0, 4, 1, 6] and [len(d) for d, _ in found] == [16, 12, 9]
