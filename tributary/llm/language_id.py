"""Operator 9, language identification by averaged hashed subword embeddings.

A text is the mean over its words of the mean over their byte n-grams (word ends marked) of hashed embeddings; a
linear softmax on that mean gives the languages. Embeddings and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample, stratified by language (`rows_per_language`). A fifth of the sample is kept out
of the fit: it sets the softmax temperature and the score below which a prediction counts as rejected.

Since the model is linear behind the embeddings, each bucket's embedding is multiplied by the softmax weights once,
and prediction sums a few numbers for each n-gram of each distinct word.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null language or id never trains; with
nothing to learn from, all texts are `und`; repeated rows are predicted row by row; extra columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, bounded_batches, coded, mix64, table, text_slices

BUCKETS = 1 << 17
DIM = 16
GRAMS = (1, 2, 3, 4)
#: Distinct texts of each language that the model is trained on, at most: those with the least hashes.
ROWS_PER_LANGUAGE = 1200
EPOCHS = 4
BATCH = 128
#: n-grams of the training texts, 4 bytes each, that are kept from one epoch to the next.
KEPT_GRAMS = 25_000_000
#: Share of right calibration predictions that the rejection score lets pass.
ACCEPT = 0.99
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of each word that has a letter, lower-cased, and the distinct words."""
    row, words = ascii_words(text)
    code, distinct = coded(words)
    distinct = pc.utf8_lower(distinct)
    lettered = pc.match_substring_regex(distinct, r"\pL").to_numpy(zero_copy_only=False)
    use = lettered[code] if len(code) else np.zeros(0, bool)
    return row[use], code[use], distinct


def _grams(distinct: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the wanted words, word after word, and how many each has."""
    words = distinct.take(pa.array(wanted)).cast(pa.large_binary())
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    n = len(words)
    size = np.diff(off) + 2  # a mark before and after
    ends = np.cumsum(size)
    flat = np.full(int(ends[-1]) if n else 0, 32, np.uint64)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
    flat[place] = data
    owner = np.repeat(np.arange(n), size)
    left = np.repeat(ends, size) - np.arange(len(flat))  # symbols from here to the word's end
    found, owners, h = [], [], np.zeros(len(flat), np.uint64)
    for g in GRAMS:
        m = len(flat) - g + 1
        if m <= 0:
            break
        h = (h[:m] << np.uint64(8)) | flat[g - 1 : g - 1 + m]
        ok = left[:m] >= g
        found.append((mix64(h[ok] + (np.uint64(g) << np.uint64(40))) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:m][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=n)


def _bag(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word occurrences (row, place among the words used), n-gram buckets and counts of those words, words per row."""
    row, code, distinct = _words(text)
    wanted, word = np.unique(code, return_inverse=True)
    grams, counts = _grams(distinct, wanted) if len(wanted) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return row, word, grams, counts, np.bincount(row, minlength=len(text))


def _by_word(table_: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the rows of the table over each word's n-grams (every word has one at least)."""
    if not len(counts):
        return np.zeros((0, table_.shape[1]), table_.dtype)
    return np.add.reduceat(table_[grams], np.cumsum(counts) - counts, axis=0) / counts[:, None]


def _by_text(values: np.ndarray, row: np.ndarray, word: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n_words), values.shape[1]), np.float64)
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(row, values[word, k], len(n_words))
    return out / np.maximum(n_words, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    languages = sorted(set(langs))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    w = rng.uniform(-1, 1, (DIM, len(languages))).astype(np.float32) / DIM
    b = np.zeros(len(languages))
    seen_e, seen_w = np.full(BUCKETS, 1e-6, np.float32), np.full(w.shape, 1e-6, np.float32)
    rng.shuffle(used)
    parts = [used[at : at + BATCH] for at in range(0, len(used), BATCH)]
    bags: dict[int, tuple[np.ndarray, ...]] = {}
    kept = 0
    for _ in range(max(epochs, min(40, 40 * BATCH // max(1, len(used))))):
        for at, rows in enumerate(parts):
            bag = bags.get(at)
            if bag is None:  # hashed once, but for what would take too much memory
                row, word, grams, counts, n_words = _bag(pa.array([texts[i] for i in rows], pa.large_string()))
                bag = tuple(v.astype(np.int32) for v in (row, word, *np.unique(grams, return_inverse=True), counts, n_words))
                if kept + len(grams) <= KEPT_GRAMS:
                    bags[at], kept = bag, kept + len(grams)
            row, word, hit, place, counts, n_words = bag
            x = _by_text(_by_word(emb[hit], place, counts), row, word, n_words)
            error = _softmax(x @ w + b)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            g_w, g_x = x.T @ error, error @ w.T
            if len(counts):
                part = (g_x / np.maximum(n_words, 1)[:, None])[row]
                g_word = np.stack([np.bincount(word, part[:, k], len(counts)) for k in range(DIM)], axis=1) / counts[:, None]
                owner = np.repeat(np.arange(len(counts)), counts)
                g_e = np.stack([np.bincount(place, g_word[owner, k], len(hit)) for k in range(DIM)], axis=1)
                seen_e[hit] += (g_e * g_e).sum(axis=1)
                emb[hit] -= (0.5 * g_e / np.sqrt(seen_e[hit])[:, None]).astype(np.float32)
            seen_w += g_w * g_w
            w -= (0.1 * g_w / np.sqrt(seen_w)).astype(np.float32)
            b -= 0.1 * error.sum(axis=0)
    model = Model(languages, emb @ w, b, 1.0, 0.0)
    if len(held):
        logits = _logits(model, pa.array([texts[i] for i in held], pa.large_string()))
        grid = 2.0 ** np.arange(-6, 4.5, 0.5)
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
        model.reject_below = float(np.quantile(right, 1 - ACCEPT)) if len(right) else 1.0
    return model


def _logits(model: Model, text: pa.Array) -> np.ndarray:
    row, word, grams, counts, n_words = _bag(text)
    return _by_text(_by_word(model.weights, grams, counts), row, word, n_words) + model.bias


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model of the rows with a text and a language; None if there are none. One task fits it on the bounded sample."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    h = F.shiftrightunsigned(F.xxhash64("text"), 2)
    # of each language the least hashes of distinct texts: copies take no share, and no language goes without a text
    hashes = rows.select("lang", h.alias("h")).distinct()
    least = hashes.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= rows_per_language)
    last = {r["lang"]: r["h"] for r in least.groupBy("lang").agg(F.max("h").alias("h")).collect()}  # one row a language
    if not last:
        return None
    bound = F.create_map(*(F.lit(x) for pair in last.items() for x in pair))
    sample = rows.withColumn("h", h).filter(F.col("h") <= bound[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for x in batches:
            texts += x.column("text").to_pylist()
            langs += x.column("lang").to_pylist()
        if texts:
            order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))  # the same model however the rows arrive
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([texts[i] for i in order], [langs[i] for i in order]))], pa.binary())], names=["model"])

    bounded_batches(labelled.sparkSession)
    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row's whole text, and the columns named in `more`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)
    kept = [f for f in rows.schema.fields if f.name not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in text_slices(batches):
            x = b.column("text")
            known = pc.match_substring_regex(x, r"\pL").to_numpy(zero_copy_only=False) & (m is not None)
            if m is None:
                best, score, reject = np.zeros(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), bool)
                names = np.array([UNKNOWN], object)
            else:
                p = _softmax(_logits(m, x) / m.temperature)
                best, names = p.argmax(axis=1), np.array(m.languages, object)
                score = p[np.arange(len(x)), best]
                reject = score < m.reject_below
            lang = np.where(known, names[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(f.name) for f in kept), pa.array(lang.tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(reject | ~known)], names=["doc_id", *(f.name for f in kept), "lang_pred", "score", "rejected"])

    schema = "doc_id long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "lang_pred string, score double, rejected boolean"
    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4
    model = train(docs.filter(F.coalesce(part != 2, F.lit(False))))
    return predict(docs, model, "doc_id", "text", F.coalesce(part == 2, F.lit(False)).alias("held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op9_language_id": op9_language_id}
