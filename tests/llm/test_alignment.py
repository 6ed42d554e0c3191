"""Token alignment against brute force: the libraries' own ids, groups and links by hand."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tributary.llm import alignment
from tributary.llm.bpe import vocabulary_path

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
TEXTS = [
    "Hello world", " leading", "trailing ", "  two  spaces  ", " ", "   ", "", None, "tabs\tand\nlines\r\n", "Ünïcödé 中文 🙂 é", "<|endoftext|> and <s> </s> <unk> <0x0A>",
    "has ▁ in it", "word " * 3000, "0123456789" * 300, " nbsp em", "a\x00b", "don't we'll I'm", "x" * 5000, "Hello world", "\n\n\n  \n", "fiń ﬁ ½",
]


def chars():
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}


def by_hand(rows):
    t, sp, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), chars()
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    out, links = [], []
    for _, text in rows:
        out.append([0, 0, 0, 0, ""])
        links.append(Counter())
        if not text:
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        bytes_a = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            continue
        i = j = end_a = end_b = 0
        groups, ga, gb, n_links = [], [], [], 0
        while i < len(a):
            links[-1][a[i], b[j]] += 1
            n_links += 1
            x, y = end_a + len(bytes_a[i]), end_b + len(bytes_b[j])
            if x <= y:
                ga.append(a[i])
                i, end_a = i + 1, x
            if y <= x:
                gb.append(b[j])
                j, end_b = j + 1, y
            if x == y:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        out[-1] = [len(a), len(b), len(groups), n_links, hashlib.sha256(";".join(groups).encode()).hexdigest()]
    count, top = Counter(p for x in links for p in x), defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(r[0], *o[:4], sum(n for p, n in x.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in x.items()), o[4]) for r, o, x in zip(rows, out, links)]


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


@pytest.mark.parametrize("size", [2 << 20, 500])
def test_alignment(spark, size, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
    rows = [*enumerate(TEXTS), (None, "Hello world"), (0, "Hello world"), (3, "another text of the same id")]
    rows += [(1000 + r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    docs = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], "doc_id long, text string, n_a string, a string, block int").repartition(3)
    got = alignment.align(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows), key=key)
    assert alignment.align(docs.limit(0), A, B).count() == 0
    assert alignment.align(docs.filter("text IS NULL OR text = ''"), A, B).count() == 2


def test_groups(spark):
    rows = [(1, "Hello world, unbelievable"), (2, None), (3, "naïve 🙂")]
    got = {r.doc_id: r.groups for r in alignment.token_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B).collect()}
    a, b = alignment.tokenizers(A, B)
    assert got[2] == []
    for i, text in rows:
        data, at = (" " + (text or "")).encode(), 0
        for g in got[i]:
            assert g.start == at and data[g.start : g.stop] == b"".join(a.pieces[k].as_py() for k in g.a) == b"".join(b.pieces[k].as_py() for k in g.b)
            at = g.stop
        assert not text or at == len(data)


def test_cut_where_pieces_begin():
    """Cutting before runs of spaces gives the ids of whole texts."""
    p = alignment.Pieces(B)
    texts = [t for t in TEXTS if t]
    assert p.cuts
    ids, off = p.encode(pa.array([" " + t for t in texts], pa.large_string()))
    assert [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:])] == [p.model.encode(t) for t in texts]
    p.cuts = False
    again, _ = p.encode(pa.array([" " + t for t in texts], pa.large_string()))
    assert again.tolist() == ids.tolist()
