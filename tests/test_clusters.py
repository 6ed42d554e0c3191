"""Clusters kept up batch by batch against one run over all records."""

import json
import random

import pytest

from tributary.model import RAW_VALUES
from tributary.operators.normalize import normalize
from tributary.operators.resolve import resolve
from tributary.streaming.clusters import ClusterState
from tributary.streaming.ingest import resolve_stream

FIRST = ["Jonathan", "Jonathon", "Johnathan", "Maria", "Mariah", "Annabelle", "Annabella"]
LAST = ["Anderssonberg", "Winterbottom", "Featherstone", "Castellanos"]


def people(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        add = lambda field, raw: rows.append((i, "CSV", field, 0, raw, None, "csv", False))  # noqa: E731, B023
        add(None, None)
        if r.random() < 0.9:
            add("full_name", f"{r.choice(FIRST)} {r.choice(LAST)}")
        if r.random() < 0.4:
            add("emails", f"p{r.randrange(n // 2)}@mail.org")
        if r.random() < 0.4:
            add("phones", f"+4930123{r.randrange(n // 2):05d}")
        if r.random() < 0.1:
            add("links", f"https://github.com/user{r.randrange(n // 4)}")
    return rows


def clusters(df):
    return {r.record_ord: r.cluster_id for r in df.collect()}


@pytest.fixture(scope="module")
def batches(spark):
    """Records of three batches, any of which may hold the first of a cluster; and the clusters of one run over each beginning."""
    rows = people(90, 4)
    part = [random.Random(i).randrange(3) for i in range(90)]
    frames = [spark.createDataFrame([x for x in rows if part[x[0]] == k], RAW_VALUES) for k in range(3)]
    wanted, so_far = [], None
    for f in frames:
        so_far = so_far.unionByName(f) if so_far is not None else f
        wanted.append(clusters(resolve(so_far, normalize(so_far))))
    return frames, wanted


def test_batches_as_one_run(spark, batches, tmp_path):
    frames, wanted = batches
    state = ClusterState(str(tmp_path / "s"), full_every=2)  # the third batch writes the whole state
    held = {}
    for k, (frame, want) in enumerate(zip(frames, wanted, strict=True)):
        held.update(clusters(state.update(frame, k)))
        assert held == want, k
        assert clusters(ClusterState(str(tmp_path / "s")).clusters(spark)) == want
    assert len(set(wanted[2].values())) < len(wanted[2]) and any(wanted[2][i] != c for i, c in wanted[0].items())


def test_again_and_empty(spark, batches, tmp_path):
    """A batch that is run again, one of known records, an empty one, and one that stopped before its commit."""
    frames, wanted = batches
    state = ClusterState(str(tmp_path / "s"))
    state.update(frames[0], 0)
    first = clusters(state.update(frames[1], 1))
    assert clusters(state.update(frames[1], 1)) == first
    assert clusters(state.update(frames[0], 2)) == {}
    assert clusters(state.update(frames[0].limit(0), 3)) == {}
    spark.createDataFrame([(0, 0, 0, 77, 9)], "record_ord long, guard int, root long, cluster_id long, batch long").write.parquet(str(tmp_path / "s" / f"{9:020d}-delta" / "records"))
    (tmp_path / "s" / f"{9:020d}-delta" / "records" / "_SUCCESS").unlink()
    assert clusters(state.clusters(spark)) == wanted[1]
    assert clusters(ClusterState(str(tmp_path / "none")).clusters(spark)) == {}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    state = ClusterState(str(tmp_path / "s"))
    arrivals = [[{"fullName": "Jane Featherstone", "email": "j@x.com"}, {"name": "Bob Ray"}], [{"fullName": "J. Featherstone", "email": "J@X.com", "phone": "+49301234567"}, {"fullName": "Jane Featherstone"}]]
    for k, lines in enumerate(arrivals):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
        resolve_stream(spark, str(tmp_path / "in"), str(tmp_path / "cp"), state).awaitTermination()
    got = clusters(state.clusters(spark))
    assert len(got) == 4 and len(set(got.values())) == 2
