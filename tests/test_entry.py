"""The driver's contract: every query with SQL gives the SQL's rows on small tables."""

import glob
import json
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tributary.operators import resolve
from tributary.plans import queries as fusion

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(fusion.ORACLE_SQL))
def test_against_sql(spark, db, name):
    got, want = fusion.QUERIES[name](spark, SF).toPandas(), db.execute(fusion.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).astype(str).values.tolist()))
    assert rows(got) == rows(want)


def ratio_by_hand(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for c in a:
        last, row = row, [0]
        for j, d in enumerate(b):
            row.append(last[j] + 1 if c == d else max(last[j + 1], row[j]))
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100


def test_name_pairs_by_hand(spark, db):
    """All pairs of one surname, both ways; and names that differ by a letter or two, which the tables hardly have."""
    found = {tuple(sorted((r.name_a, r.name_b))) for r in fusion.surname_block_pairs(spark, SF).collect()}
    names = [n for (n,) in db.execute("SELECT DISTINCT p_name FROM part").fetchall()]
    pairs = lambda xs: {tuple(sorted((a, b))) for i, a in enumerate(xs) for b in xs[:i] if a.split()[-1] == b.split()[-1] and ratio_by_hand(a, b) >= 90}
    assert found == pairs(names)
    people = ["jon smith", "john smith", "jonh smith", "jo smith", "maria smith", "marie smith", "smith", "a smith", "b smith", "johan van der smith", "johann van der smith", "ann wood", "anne wood", "x y wood"]
    rows = spark.createDataFrame([(n.split()[-1], i, n, i) for i, n in enumerate(people)], "surname string, root long, name string, ord long")
    got = {tuple(sorted((r.name_a, r.name_b))) for r in resolve.name_pairs(rows, 90.0).collect()}
    assert got == pairs(people) and len(got) >= 4


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    from tributary.streaming.ingest import start

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in [{"fullName": "Jane Doe", "email": " J@X.com ", "skills": ["ML"]}, {"name": "Bob"}]) + "\nnot json\n")
    got = []
    start(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, _: got.extend(df.select("field", "v_str").collect())).awaitTermination()
    assert sorted(map(tuple, got)) == [("emails", "j@x.com"), ("full_name", "Bob"), ("full_name", "Jane Doe"), ("skills", "Machine Learning")]
