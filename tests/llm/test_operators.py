"""Each corpus operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm import blocks, bpe, language_id, ngram_join, packing, quality_classifier, quality_rules, repair, sharding, suffix_dedup, vector_search

WORD, BYTE = bpe.vocabulary_path("word_bpe_49k.json"), bpe.vocabulary_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, sequence_id string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark):
    base = "The quick brown fox jumps over the lazy dog and runs through seven quiet forests before the long night falls again on the river bank today"
    texts = [
        base, base, base + " once more", base.upper(), None, "", "   ", "\n\n", "one", "one two", "ONE two", "a b c a b c a b c " * 20,
        "symbols### ***all&&& over%%% " * 30, "line one is here\nline one is here\nline one is here\nline one is here\nother " * 3,
        "Été où l'on ne sait plus où aller, ça et là " * 8, "Der Straße entlang, über Brücken und Flüsse " * 8, "<|endoftext|>special<|startoftext|>", "tabs\tand  double spaces \n mixed\r\n ends ",
        "word " * 30_000, "0123456789" * 700, "İstanbul ΟΔΟΣ 中文 🙂  x", base[20:90] + " different tail of the text " + base[40:110],
    ]
    out = [(i, t, ["en", "fr", None][i % 3], f"host{i % 4}" if i % 5 else None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[3], (None, base, "en", "host1", "c", "c", "c"), (None, None, None, None, None, None, None), (-7, base + " before", "en", "h", "c", "c", "c")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(path, text):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t.encode(text or "", add_special_tokens=False).ids


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


# 1


def test_packing(docs, rows, none):
    pieces = packing.pack(docs, WORD).collect()
    tokens = defaultdict(list)
    for r in rows:
        tokens[r[0]].append(np.array([*ids_of(WORD, r[1]), 2], "<u4"))
    covered = Counter()
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length]) == p.ids_crc32 for x in tokens[p.doc_id])
        covered[p.doc_id] += p.length
    assert covered == Counter({k: sum(map(len, v)) for k, v in tokens.items()})
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by_seq) <= -(-sum(covered.values()) // packing.CAPACITY) + 1
    assert packing.pack(none, WORD).count() == 0


def test_cut_and_fill():
    n = np.arange(1, 20_000, 7)
    doc, start, length = packing.cut(n)
    assert (np.bincount(doc, length) == n).all() and length.max() <= packing.CAPACITY
    bin_, offset, bins = packing.fill(length)
    k = packing.CAPACITY // length
    for b in range(0, bins, 97):
        inside = bin_ == b
        assert inside.sum() == k[inside][0] and len(set(k[inside])) == 1 and length[inside].sum() <= packing.CAPACITY
    left = bin_ < 0
    assert all(Counter(k[left])[c] < c for c in set(k[left]))


def test_sequences(spark, docs):
    unique = docs.filter("doc_id IS NOT NULL AND doc_id <> 3")
    pieces = packing.pack(unique, WORD)
    got = {r.sequence_id: r.ids for r in packing.sequence_ids(unique, pieces, WORD).collect()}
    text = {r.doc_id: r.text for r in unique.collect()}
    for p in pieces.collect():
        assert got[p.sequence_id][p.offset : p.offset + p.length] == [*ids_of(WORD, text[p.doc_id]), 2][p.start : p.start + p.length]
    assert {len(x) for x in got.values()} == {packing.CAPACITY}


# 2


def measures(text):
    text = text or ""
    w = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    often = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(often)


def test_quality_rules(docs, rows, none):
    got = quality_rules.apply_quality_rules(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((r[0], *measures(r[1])) for r in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply_quality_rules(none).count() == 0
    assert sorted(r.doc_id or -1 for r in quality_rules.kept_rows(docs).collect()) == sorted(r.doc_id or -1 for r in got if r.kept)
    assert quality_rules.kept_rows(docs).columns == docs.columns


def beta_verdicts(failed_of):
    """host -> posterior mean of its failure rate, from host -> list of failures, by the method of moments."""
    n, f = sum(map(len, failed_of.values())), sum(map(sum, failed_of.values()))
    m = f / n
    within = sum(len(x) * (sum(x) / len(x) - m) ** 2 for x in failed_of.values())
    free = n - sum(len(x) ** 2 for x in failed_of.values()) / n
    v = (within - (len(failed_of) - 1) * m * (1 - m)) / free if free else 0.0
    s = min(n, max(1e-3, m * (1 - m) / v - 1)) if v > 0 else n
    return {h: (sum(x) + m * s) / (len(x) + s) for h, x in failed_of.items()}


def test_quality_verdicts_by_hand(spark):
    """Rates of hosts and verdicts recomputed from the texts alone: a bad host, small ones, one without a name, a null text."""
    good, bad = " ".join(f"word{i}" for i in range(70)), "spam and more " * 40
    rows = [(i, bad if i % 20 else good, "bad.example") for i in range(60)]
    rows += [(100 + i, bad if i % 9 == 0 else f"{good} {i}", f"host{i % 7}") for i in range(150)]
    rows += [(300, bad, "tiny.example"), (301, None, None), (302, good, None), (303, "a # b & " * 40 + good, "host1"), (304, "same line of words here\n" * 9 + good, "host2")]

    def breaks(text):
        n, _, symbols, dup, again = measures(text)
        lines = sum(bool(WORDS.search(x)) for x in (text or "").split("\n"))
        return n < 50 or 100 * again > 50 * n or symbols > 0.3 * max(n, 1) or (dup >= 3 and dup > 0.5 * lines)

    hosts = defaultdict(list)
    for _, text, host in rows:
        hosts[host].append(breaks(text))
    rate = beta_verdicts(hosts)
    got = {r.doc_id: r for r in quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()}
    for i, text, host in rows:
        assert got[i].host_rate == pytest.approx(rate[host], rel=1e-9)
        assert got[i].kept == (not breaks(text) and rate[host] <= 0.8), i
    assert not got[0].kept and not breaks(rows[0][1]) and rate["tiny.example"] < 0.8 < rate["bad.example"]


def test_host_prior(spark):
    bad = [("bad", True)] * 50 + [("small", True)] + [(f"h{i % 9}", i % 10 == 0) for i in range(900)]
    v = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(bad, "host string, failed boolean"), 0.8).collect()}
    assert v["bad"].host_rejected and not v["small"].host_rejected and v["small"].host_rate < 0.8 and not v["h1"].host_rejected


# 3


def test_bpe(docs, rows, none):
    t = Tokenizer.from_file(WORD)
    want = []
    for r in rows:
        ids = ids_of(WORD, r[1])
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, WORD).collect()), key=key) == sorted(want, key=key)
    assert bpe.round_trip(none, WORD).count() == 0
    encoded = bpe.encode_rows(docs, BYTE)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=key) == sorted(((r[0], ids_of(BYTE, r[1])) for r in rows), key=key)
    assert sorted(map(tuple, bpe.decode_rows(encoded.filter("doc_id <> 16"), BYTE).collect())) == sorted((r[0], r[1] or "") for r in rows if r[0] is not None and r[0] != 16)


# 4


def test_vectors(spark):
    rng = np.random.default_rng(1)
    table = [(i, [float(x) for x in rng.normal(0, 0.1, 8)]) for i in range(400)]
    table += [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, [0.5, 0.5]), (404, []), (7, table[7][1]), (None, [0.1] * 8), (500, table[3][1]), (600, [float("inf")] * 8)]
    df = spark.createDataFrame([(a, b, "c") for a, b in table], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in vector_search.top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.floor(1024 * np.pad(np.array(v), (0, 8 - len(v)))).astype(int)) for i, v in table if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if q % 100 == 0:
            scores = sorted(((-int(v @ x), i) for i, x in good if i != q))[:10]
            assert got.pop(q) == [(i, -s) for s, i in scores]
    assert not got
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0


def test_vectors_of_large_components_and_small_groups(spark, monkeypatch):
    """Scores near 2**60 are exact integers; groups and shards of one block give the same rows."""
    for name in ("BLOCK_ROWS", "QUERY_ROWS", "SHARD_BLOCKS", "GROUP_BLOCKS"):
        monkeypatch.setattr(vector_search, name, {"BLOCK_ROWS": 16, "QUERY_ROWS": 2}.get(name, 1))
    x = np.random.default_rng(2).normal(0, 2e5, (300, 8))
    got = defaultdict(list)
    for r in vector_search.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 300, 20):
        assert got[q] == [(i, -s) for s, i in sorted((-int(sum(int(a) * int(b) for a, b in zip(v[q], v[i]))), i) for i in range(300) if i != q)[:10]]


def test_maxscore_skips_terms():
    """Only essential postings are traversed: a block whose bound is below the threshold is not, and few terms decide here."""
    rng = np.random.default_rng(3)
    q = np.array([1000, *[1] * 31])
    vecs = np.concatenate([rng.integers(-100, 101, (500, 1)), rng.integers(-3, 4, (500, 31))], axis=1)
    block = vector_search.Postings(np.arange(500), vecs)
    read = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            read.append(at[0].size if isinstance(at, tuple) else len(at))
            return np.asarray(super().__getitem__(at))

    block.terms = block.terms.view(Seen)
    exact = vecs @ q
    threshold = int(np.sort(exact)[-10])
    score, ids = vector_search.maxscore_block(q, block, None, threshold, 10)
    assert sorted(score.tolist()) == sorted(exact[exact >= threshold].tolist())[-10:] and read[0] == 1
    read.clear()
    assert not len(vector_search.maxscore_block(q, block, None, 10**9, 10)[0]) and not read


# 5


def cut_by_hand(rows, length):
    data = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            least[x] = min(least.get(x, 2**63), i)
    out = []
    for (i, b), (doc, _) in zip(data, rows):
        depth = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < i:
                depth[s] += 1
                depth[s + length] -= 1
        goes = np.cumsum(depth[:-1]) > 0
        edge = np.diff(np.concatenate([[0], goes.astype(int), [0]]))
        out.append((doc, len(b), int(goes.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~goes].tobytes()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("length,anchor,small", [(50, 24, {}), (20, 8, {"CHUNK": 300, "SUFFIXES": 40, "WINDOWS": 60, "PART_WINDOWS": 50, "BUCKET_BYTES": 5000, "BLOCK_BYTES": 2000}), (20, 8, {"HOT_UNITS": 2, "CHUNK": 300, "SUFFIXES": 40, "WINDOWS": 60, "PART_WINDOWS": 50, "BUCKET_BYTES": 5000, "BLOCK_BYTES": 2000})])
def test_suffix_dedup(docs, rows, none, length, anchor, small, monkeypatch):
    for k, v in small.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    got = suffix_dedup.remove_repeats(docs.repartition(2), length, anchor)
    assert got.columns == [*docs.columns, suffix_dedup.RESULT]
    r = F.col(suffix_dedup.RESULT)
    found = got.select("doc_id", r["n_bytes"], r["n_removed"], F.size(r["spans"]), r["kept_sha256"]).collect()
    assert sorted(map(tuple, found), key=key) == cut_by_hand([(x[0], x[1]) for x in rows], length)
    assert suffix_dedup.remove_repeats(none, length, anchor).count() == 0


def test_suffix_dedup_clash_and_hash_collisions(spark, docs, monkeypatch):
    """A column with the result's name stays; strings that share a hash are told apart by their bytes."""
    clash = docs.withColumn(suffix_dedup.RESULT, F.lit("mine"))
    assert suffix_dedup.remove_repeats(clash).columns == [*clash.columns, suffix_dedup.RESULT + "_"]
    data = np.frombuffer(b"abcdabceabcd", np.uint8)
    start, size, same = np.array([0, 4, 8]), np.full(3, 4), np.zeros(3, np.uint64)
    order, new = suffix_dedup.distinct_strings(data, start, size, same, same, np.array([2, 1, 0]))
    assert order.tolist() == [2, 1, 0] and new.tolist() == [True, True, True]  # only neighbours of equal bytes are one


def log_lines(n, seed):
    r = np.random.default_rng(seed)
    return "\n".join(f"2024-05-01 INFO request-id={k:012d}" for k in r.integers(0, 10**12, n)) + "\n"


def test_suffix_dedup_of_log_lines(spark):
    """A passage inside every line: one anchor has a unit for each line of few documents."""
    a, b = log_lines(400, 1), log_lines(300, 2)
    rows = [(1, a), (2, b), (3, a[1000:3000] + b[500:700]), (4, log_lines(50, 3) + a[:400])]
    r = F.col(suffix_dedup.RESULT)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, 24).select("doc_id", r["n_bytes"], r["n_removed"], F.size(r["spans"]), r["kept_sha256"])
    assert sorted(map(tuple, got.collect()), key=key) == cut_by_hand(rows, 50)


def test_suffix_dedup_memory_of_a_hot_anchor():
    """The units of one anchor take a few times the bytes of their texts."""
    import tracemalloc

    n = 60_000
    text = log_lines(n, 4).encode()
    line = len(text) // n
    data = np.frombuffer(text, np.uint8)
    start = np.arange(n - 3) * line
    size = np.full(len(start), 74)
    u = np.zeros(len(start), suffix_dedup._UNIT)
    u["doc"], u["id"], u["size"] = np.arange(len(start)) % 2, np.arange(len(start)), size
    same = np.zeros(len(start), np.uint64)
    order, new = suffix_dedup.distinct_strings(data, start, size, suffix_dedup.string_hashes(data, start, start + size), same, u["doc"])
    tracemalloc.start()
    unit, found = suffix_dedup._news(u, same, order, new, start, size, data, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(found) and peak < 60 * len(text)


def test_suffix_dedup_memory_of_a_long_text():
    """Anchors of a text take a few bytes for each of its bytes, however long it is."""
    import tracemalloc

    text = np.random.default_rng(1).integers(97, 123, 20 << 20).astype(np.uint8).tobytes().decode()
    t = suffix_dedup.Text.of(pa.array([1]), pa.array([text], pa.large_string()))
    tracemalloc.start()
    first, size, _, _ = t.units(50, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int(size.sum()) == len(text) - 49 and (first[1:] == first[:-1] + size[:-1]).all() and peak < 20 * len(text)


def test_maximal_repeats():
    data = np.frombuffer(b"xabcabcabdyabcabq", np.uint8)
    start = np.arange(len(data))
    sa, shared = suffix_dedup.suffix_array(data, start, np.full(len(data), len(data)))
    assert [bytes(data[i:]) for i in sa] == sorted(bytes(data[i:]) for i in start)
    left = np.where(sa > 0, data[np.maximum(sa - 1, 0)].astype(int), -1)
    size, lo, hi, _ = suffix_dedup.maximal_repeats(shared, left, sa, 2)
    got = {bytes(data[sa[a] : sa[a] + n]): sorted(sa[a : b + 1].tolist()) for n, a, b in zip(size, lo, hi)}
    assert got[b"abcab"] == [1, 4, 11] and b"bcab" not in got and got[b"ab"] == [1, 4, 7, 11, 14]


# 6


def components_by_hand(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("setting", [{}, {"GROUP_GRAMS": 0, "SMALL_LIST": 2, "HOT": 3, "PAIRS_PER_ENTRY": 0.01}])
def test_jaccard(spark, docs, rows, none, setting, monkeypatch):
    for k, v in setting.items():
        monkeypatch.setattr(ngram_join, k, v)
    base = [f"w{i}" for i in range(80)]
    near = []
    for i in range(60):  # a large group of near copies, each with a word or two of its own
        w = list(base)
        w[(7 * i) % 80] = f"own{i}"
        w[(11 * i + 3) % 80] = f"too{i % 9}"
        near.append((1000 + i, " ".join(w)))
    table = [(x[0], x[1]) for x in rows if x[0] is not None] + near
    df = spark.createDataFrame([(*x, "c") for x in table], "doc_id long, text string, component_id string")
    for n, percent in ((3, 90), (5, 80)):
        want = components_by_hand(dict(table).items(), n, percent)
        for r in ngram_join.jaccard_components(df, n, percent).collect():
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    nulls = [r for r in ngram_join.jaccard_components(docs, 3, 90).collect() if r.doc_id is None]
    assert len(nulls) == 2 and all(r.component_id is None for r in nulls)
    assert ngram_join.jaccard_components(none, 3, 90).count() == 0


@pytest.mark.parametrize("factor", [4, 0.01])
def test_jaccard_pair_of_several_grams(spark, factor, monkeypatch):
    """A pair found by two grams: one side's row may come from the first, the other's from the second."""
    monkeypatch.setattr(ngram_join, "GROUP_GRAMS", 0)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ENTRY", factor)
    texts = [" ".join([*(f"w{i}" for i in range(21)), last]) for last in ("one", "two")]  # 19 of 21 grams in common
    blocks_ = blocks.text_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "text", 1 << 20, "test")
    keys = [0, 1]
    found = []
    for pos, gram in ((0, 11), (2, 12)):
        e = np.zeros(2, ngram_join._ENTRY)
        e["gram"], e["class"], e["size"], e["pos"], e["digest"] = gram, keys, 20, pos, 255
        found.append({r["class"]: r for r in ngram_join._shared(90, 4)(pa.table({"bucket": [gram % 4], "blob": [blocks.planes(e)]})).to_pylist()})
    mixed = [found[0][keys[0]], found[1][keys[1]]]
    assert mixed[0]["gram"] == mixed[1]["gram"]
    columns = ("gram", "class", "size", "pos", "digest")
    entries = spark.createDataFrame([tuple(r[c] for c in columns) for r in mixed], ", ".join(f"{c} long" for c in columns))
    comp = ngram_join.class_components(ngram_join._Join(blocks_, 3, 90), entries)
    assert {r["class"]: r["comp"] for r in comp.collect()} == dict.fromkeys(keys, 0)


def test_first_of_components(spark):
    """Decided row by row: a repeated doc_id takes no other row along, and rows without one stay."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " end"), (2, "quite another text"), (None, text), (None, text), (3, None), (3, ""), (5, text), (1, text)]
    df = spark.createDataFrame([(a, b, "x", 1, "y") for a, b in rows], "doc_id long, text string, row string, block int, places string").repartition(3)
    got = ngram_join.first_of_components(df, 3, 90)
    assert got.columns == df.columns and got.schema == df.schema
    want = [(1, text), (2, "quite another text"), (None, text), (None, text), (3, None), (3, "")]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
    assert ngram_join.first_of_components(df.limit(0), 3, 90).count() == 0


# 7


def jump(k, n):
    b, j = -1, 0
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_sharding(docs, rows, none):
    got = sharding.shard_documents(docs, 24).collect()
    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    slots = defaultdict(list)
    for r in got:
        assert r.shard == jump(keys[r.doc_id] % (1 << 64), 24) and r.grown_shard == jump(keys[r.doc_id] % (1 << 64), 25)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in rows), key=key)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=key) == want
    assert sharding.shard_documents(none).count() == 0


def test_sharding_moves_only_to_the_new_shard(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(df, 10).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_documents(df, 11).collect()}
    moved = [i for i in a if a[i][0] != b[i]]
    assert all(a[i][1] == b[i] for i in a) and all(b[i] == 10 for i in moved) and 0.05 < len(moved) / 3000 < 0.14


def test_sharding_of_one_key(spark, monkeypatch):
    """Many rows of one id and of none, with few texts: gapless slots, every copy comes back, buckets split the key."""
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 7)
    df = spark.range(2000).select(F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 < 4, 3).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("text"))
    got = sharding.shard_documents(df, 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r.doc_id, zlib.crc32(r.text.encode())) for r in df.collect())
    assert Counter((r.doc_id, r.text_crc32) for r in got) == want


# 8 and 9


def test_quality_classifier(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = real.select("doc_id", (quality_classifier.quality_score(real) >= 0.5).alias("kept")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    by = {(r.quality, r.kept): r["count"] for r in kept.groupBy("quality", "kept").count().collect()}
    assert by[(1, True)] >= 0.95 * (by[(1, True)] + by.get((1, False), 0)) and by[(0, False)] >= 0.9 * (by[(0, False)] + by.get((0, True), 0))
    assert quality_classifier.classified(docs).columns == docs.columns
    assert quality_classifier.classified(none).count() == 0


def test_votes_of_labellers():
    v = quality_classifier
    patterns = np.array([(np.array(p) @ v._PLACES) for p in ((0, 0, 0, 0, 0, 0, 0, 1, 1), (2, 0, 0, 0, 0, 0, 0, 2, 1), (0, 2, 2, 0, 0, 2, 0, 2, 2))])
    good, _, prior = v.pattern_posteriors(patterns, np.array([900.0, 60.0, 40.0]))
    assert good[0] > 0.9 and good[1] < 0.1 and good[2] < 0.1 and 0.8 < prior < 0.95


def test_em_by_hand():
    """pattern_posteriors against EM written out for single documents."""
    v = quality_classifier
    rng = np.random.default_rng(4)
    docs_ = [tuple(rng.choice(3, 9, p=[0.6, 0.25, 0.15] if rng.random() < 0.7 else [0.4, 0.1, 0.5])) for _ in range(300)]
    count = Counter(int(np.array(d) @ v._PLACES) for d in docs_)
    patterns = np.array(sorted(count))
    got, rates, prior = v.pattern_posteriors(patterns, np.array([count[p] for p in patterns.tolist()], float), rounds=7)
    p = [0.05 if v.BAD in d else 0.95 for d in docs_]
    for _ in range(7):
        share = (sum(p) + 1) / (len(docs_) + 2)
        rate = {}
        for c in (0, 1):
            w = [x if c else 1 - x for x in p]
            for k in range(9):
                for vote in range(3):
                    rate[c, k, vote] = (sum(x for x, d in zip(w, docs_) if d[k] == vote) + 0.1) / (sum(w) + 0.3)
                if c:
                    rate[c, k, v.BAD] = min(rate[c, k, v.BAD], v.MAX_FALSE_BAD)
        p = []
        for d in docs_:
            good, bad = share, 1 - share
            for k, vote in enumerate(d):
                if vote != v.ABSTAIN:
                    good, bad = good * rate[1, k, vote], bad * rate[0, k, vote]
            p.append(good / (good + bad))
    by = dict(zip(patterns.tolist(), got))
    assert np.allclose([by[int(np.array(d) @ v._PLACES)] for d in docs_], p) and np.isclose(prior, share)


def test_fits_do_not_depend_on_partitions(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    copies = real.unionByName(real.filter("doc_id = 3").crossJoin(spark.range(100)).drop("id"))
    a, b = copies.repartition(3), copies.repartition(11, "doc_id")
    (w, p), (v, q) = (quality_classifier.train(x, sample_rows=40) for x in (a, b))
    assert p == q and (w == v).all()
    assert quality_classifier.train(real.limit(0))[1] == {} and (quality_classifier.train(real, sample_rows=0)[0] == 0).all()
    m, n = (language_id.train(x, rows_per_language=20) for x in (a, b))
    assert (m.weights == n.weights).all() and m.temperature == n.temperature


def test_language_forward_pass(spark):
    """Scores against the mean of the mean of n-gram weights, computed word by word."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = language_id.train(real, rows_per_language=20)
    for t in [r.text for r in real.filter("text IS NOT NULL").limit(20).collect()]:
        words = [w.lower() for w in WORDS.findall(t) if re.search(r"[^\W\d_]", w)]
        total = np.zeros(len(m.languages))
        for w in words:
            b = b" " + w.encode() + b" "
            hashes = [int(language_id.mix64(np.array([int.from_bytes(b[i : i + g], "big") + (g << 40)], np.uint64))[0]) % language_id.BUCKETS for g in language_id.GRAMS for i in range(len(b) - g + 1)]
            total += m.weights[hashes].mean(axis=0)
        want = total / max(1, len(words)) + m.bias
        assert np.allclose(language_id._logits(m, pa.array([t], pa.large_string()))[0], want, atol=1e-4)


def test_language(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(real.filter("doc_id % 2 = 0"))
    held = language_id.predict(real.filter("doc_id % 2 = 1"), model).join(real.select("doc_id", "lang"), "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    got = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, model).filter("doc_id IN (4, 5, 6, 19)").collect()}
    assert got == {(i, "und", 0.0) for i in (4, 5, 6, 19)}
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"} and language_id.predict(none, model).count() == 0


# 10


def test_repair(docs, rows, none, monkeypatch):
    got = repair.read_shards(repair.write_shards(docs, BYTE, shard_ids=200)).collect()
    data = sorted(((-(2**63) if x[0] is None else x[0], [*ids_of(BYTE, x[1]), 2]) for x in rows), key=lambda x: x[0])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((None if i == -(2**63) else i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in data)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert repair.read_shards(repair.write_shards(none, BYTE)).count() == 0


def test_repair_of_equal_rows(spark):
    """Rows of one text without an id are spread over the partitions; positions stay gapless."""
    df = spark.range(0, 4000, 1, 3).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"))
    shards = repair.write_shards(df, BYTE)
    assert shards.select("part").distinct().count() > 1
    n = len(ids_of(BYTE, "one and the same text")) + 1
    got = repair.read_shards(shards).collect()
    assert sorted(r.start for r in got) == list(range(0, 4000 * n, n)) and {r.n_tokens for r in got} == {n}


def test_repair_files(spark):
    """Shards of the stated size, smaller than 16-bit ids, and any range of the whole by its position."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(1).withColumn("doc_id", F.lit(-(2**63)).cast("long")))
    most = 20_000
    shards = repair.write_shards(real, BYTE, shard_ids=most)
    longest = repair.read_shards(shards).agg(F.max("n_tokens"), F.min("doc_id")).first()
    assert longest[1] == -(2**63)  # no mark for a missing id
    s = shards.select("n_ids", F.length("block").alias("size")).collect()
    assert all(r.n_ids <= max(most, longest[0]) for r in s) and len(s) <= 2 + 2 * sum(r.n_ids for r in s) // most + 8
    assert sum(r["size"] for r in s) < 1.8 * sum(r.n_ids for r in s)  # plain ids take 2 bytes; small shards repeat little
    texts = [r.text for r in real.orderBy("doc_id").collect()]
    all_ids = np.concatenate([[*ids_of(BYTE, t), 2] for t in texts])
    for a, b in ((0, 10), (most - 7, 3 * most + 5), (len(all_ids) - 3, len(all_ids))):
        parts = repair.read_range(shards, a, b).orderBy("position").collect()
        assert [i for r in parts for i in r.ids] == all_ids[a:b].tolist() and parts[0].position == a


@pytest.mark.parametrize("symbols", [1, 2, 5, 60_000])
def test_repair_round_trip(symbols):
    rng = np.random.default_rng(symbols)
    for n in (0, 1, 2, 3, 50, 2000):
        x = rng.integers(0, symbols, n)
        block = repair.Block(repair.to_block(np.array([1]), np.array([0, n]), x, 3))
        assert (block.ids(0, n) == x).all()
        for _ in range(5):
            i, j = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (block.ids(i, j) == x[i:j]).all()
