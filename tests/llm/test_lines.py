"""Common lines against brute force, and the index against a dictionary."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import line_dedup


def by_hand(rows, min_docs, min_chars):
    lines = [(t or "").split("\n") for _, t in rows]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    docs = Counter(k for x in lines for k in {key(y) for y in x})
    gone = {k for k, n in docs.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for (i, _), x in zip(rows, lines):
        rest = [y for y in x if key(y) not in gone]
        text = "\n".join(rest)
        out.append((i, text, len(x), len(x) - len(rest), hashlib.sha256(text.encode()).hexdigest()))
    return out


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    pool = ["Cookie notice", "  COOKIE NOTICE\t", "Été", "ÉTÉ", "x", "", " ", "\r", "İ", "Share this page\r", "share this page", " nbsp ", "a\x00b", "\x1cunit"]
    pool += [f"line {i}" for i in range(300)]
    weight = 1 / np.arange(1, len(pool) + 1)
    out = [(i, "\n".join(pool[k] for k in rng.choice(len(pool), rng.integers(1, 15), p=weight / weight.sum()))) for i in range(300)]
    out += [(900, None), (901, ""), (902, "\n"), (903, "\n\nend\n"), (904, "solo\n" * 5000), (905, "Cookie notice"), (905, "Cookie notice"), (None, "Cookie notice\nkept text"), (None, None)]
    return [*out, (906, "z " * 200_000 + "\nCookie notice")]


@pytest.mark.parametrize("setting", [{}, {"INDEX_BYTES": 0}, {"INDEX_BYTES": 0, "SHARD_LINES": 3, "SLICE_BYTES": 500, "BLOCK_BYTES": 700}, {"SHARD_LINES": 5, "SLICE_BYTES": 300}])
@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (3, 5)])
def test_lines(spark, rows, setting, min_docs, min_chars, monkeypatch):
    for k, v in setting.items():
        monkeypatch.setattr(line_dedup, k, v)
    docs = spark.createDataFrame([(a, b, "mine", "c", 1) for a, b in rows], f"doc_id long, text string, {line_dedup.RESULT} string, h1 string, block int").repartition(3)
    got = line_dedup.drop_common_lines(docs, min_docs, min_chars, index_bytes=line_dedup.INDEX_BYTES)
    assert got.columns == [*docs.columns, line_dedup.RESULT + "_"]
    r = F.col(line_dedup.RESULT + "_")
    found = [tuple(x) for x in got.select("doc_id", "text", r["n_lines"], r["n_dropped"], r["kept_sha256"]).collect()]
    assert sorted(found, key=key) == sorted(by_hand(rows, min_docs, min_chars), key=key)
    assert {(x[line_dedup.RESULT], x.h1, x.block) for x in got.collect()} == {("mine", "c", 1)}
    assert line_dedup.drop_common_lines(docs.limit(0), index_bytes=line_dedup.INDEX_BYTES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000, 60_000])
def test_index(n):
    """Slots are minimal and perfect, counts exact, strangers unknown."""
    rng = np.random.default_rng(n)
    keys = np.empty(n + 5000, line_dedup._KEY)
    keys["h1"], keys["h2"] = rng.integers(0, 2**63, (2, len(keys)), np.uint64)
    keys["h1"][: n // 2] = 7  # told apart by the other half
    counts = rng.integers(1, 1 << 40, n)
    data = line_dedup.LineIndex.build(keys[:n], counts)
    index = line_dedup.LineIndex(data)
    assert sorted(index.slots(keys[:n]).tolist()) == list(range(n))
    assert (index.count(keys[:n]) == np.minimum(counts, 2**32 - 1)).all() and not index.count(keys[n:]).any()
    assert n < 1000 or len(data) < line_dedup.LINE_BYTES * n
