"""The pipeline's stages on documents with planted cases, and run() against its stages by hand."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import WORD, components_by_hand, cut_by_hand, ids_of  # noqa: E402

from tributary.llm import packing  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    words = np.array([f"{a}{b}{c}" for a in "btkmnrsl" for b in "aeiou" for c in "dfgpvz"])
    text = lambda n: "\n".join(" ".join(rng.choice(words, 12)).capitalize() + "." for _ in range(n))
    passage = text(6)
    docs = [(i, text(12), "en", f"src{i % 5}") for i in range(120)]
    docs += [(200, docs[3][1], "en", "src1"), (201, docs[4][1].replace("a", "a", 1) + " tail", "en", "src2")]  # copies
    docs += [(210 + i, text(6) + "\n" + passage + "\n" + text(6), "en", "src3") for i in range(4)]  # a shared passage
    docs += [(220 + i, "go now go now " * 60, "en", "src4") for i in range(8)] + [(230 + i, text(8).replace(" ", "### "), "en", "src0") for i in range(8)]  # junk
    docs += [(240, None, None, None), (241, "", "en", "src0"), (None, text(12), "en", "src1")]
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(d / "documents.parquet"))
    return str(d), rows, passage


def test_stages(spark, folder):
    d, rows, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(120))
    assert clean <= set(seen["quality classifier"]) and not set(seen["quality classifier"]) & {*range(220, 228), *range(230, 238)}
    assert clean <= set(seen["quality rules"]) and not {240, 241} & set(seen["quality rules"])
    assert set(seen["quality rules"]) - set(seen["n-gram Jaccard join"]) == {200, 201} and None in seen["n-gram Jaccard join"]
    want = components_by_hand([(i, t) for i, t in seen["quality rules"].items() if i is not None], 5, 80)
    assert {i for i, (_, c) in want.items() if i == c} == {i for i in seen["n-gram Jaccard join"] if i is not None}
    cut = {r[0]: r[2] for r in cut_by_hand(list(seen["n-gram Jaccard join"].items()), corpus_pipeline.PASSAGE_BYTES)}
    for i, t in seen["suffix-array dedup"].items():
        assert len(t.encode()) == len(seen["n-gram Jaccard join"][i].encode()) - cut[i]
    assert passage in seen["suffix-array dedup"][210] and all(passage not in seen["suffix-array dedup"][210 + i] for i in (1, 2, 3))
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.run(spark, d).collect()
    assert sum(p.length for p in pieces) == sum(len(ids_of(WORD, t)) + 1 for t in seen["suffix-array dedup"].values())
    assert max(p.offset + p.length for p in pieces) <= packing.CAPACITY


def test_stages_on_empty_tables_and_clashing_columns(spark, folder):
    """No rows give no rows; columns whose names the operators use themselves stay as they are."""
    d, rows, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = ("__measures", "__host", "__dedup", "row", "block", "places", "score", "c0", "Host")
    wide = docs.selectExpr("*", *(f"'mine' AS `{n}`" for n in names))
    some = wide.filter("doc_id < 20 OR doc_id IS NULL OR doc_id = 200")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), d).count() == 0, name
        if name != "packing":
            got = stage(spark, some, d)
            assert got.columns == wide.columns and all(r[n] == "mine" for r in got.collect() for n in names), name
