"""What keeps time and memory in proportion to the input: seen in plans and partitions, not timed."""

from pyspark.sql import functions as F

from tributary.functions.text import phone, token_sort_ratio
from tributary.operators import linking, merge, resolve
from tributary.plans import pipeline, queries
from tributary.plans.storage import written
from tributary.sources.json_profiles import ats_values
from tributary.sources.resume import EXPERIENCE, parse_documents


SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_similar_names_are_compared_once_a_pair(spark):
    rows = [(s, f"{first} {s}") for s, n in (("few", 3), ("edge", resolve.FEW_NAMES), ("over", resolve.FEW_NAMES + 1)) for first in ("Jonathan", "Jonathon", "Jonatan", "Maria", "Marian", "Mariam", "Peter", "Petra", "Jonathans")[:n]]
    names = spark.createDataFrame([*rows, ("alone", "Ada alone")], "surname string, name string")
    got = resolve.similar_names(names, 90.0)
    assert "Join" not in optimized(got) and "Aggregate" not in optimized(got)  # no pair meets the comparison twice
    a, b = (names.select("surname", F.col("name").alias(f"name_{side}")) for side in "ab")
    want = a.join(b, "surname").filter("name_a < name_b").filter(token_sort_ratio(F.col("name_a"), F.col("name_b")) >= 90.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_small_files_of_many_rows_are_spread(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(queries, "TASK_ROWS", 30)
    got = queries.spread(spark.read.parquet(str(tmp_path / "t")))
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100


def test_resume_jobs_are_found_once_a_document(spark):
    docs = spark.createDataFrame([(1, "Ada Lovelace\nExperience\nAcme Jan 2010 - Dec 2011\nEducation\nB.Sc. Physics, UNI 7, Optics (Sep 2001 to Jun 2005)\n")], "record_ord long, text string")
    rows = parse_documents(docs)
    # the headers of the jobs' sections are looked for in one place only
    assert optimized(rows).count(EXPERIENCE) == 1
    got = {r["field"]: r for r in rows.filter("field IS NOT NULL").collect()}
    assert got["years_experience"]["raw"] == "2"
    assert tuple(got["education"]["edu"]) == ("UNI 7", "B.Sc. Physics", "Optics", "2001-09", "2005-06")


def test_candidates_are_read_once(spark):
    rows = spark.createDataFrame([(1, '{"name": "A", "skills": ["x"], "location": {"city": "Lima"}}'), (2, '{"other": 1}'), (3, "{}")], "record_ord long, obj string")
    got = ats_values(rows)
    plan = optimized(got)
    assert "Join" not in plan and plan.count("get_json_object(obj#") == 12  # a lookup a key
    assert sorted((r["record_ord"], r["field"] or "", r["raw"] or "") for r in got.collect()) == [(1, "", ""), (1, "full_name", "A"), (1, "location", "Lima"), (1, "skills", "x")]


def test_inputs_of_the_merges_are_spread(spark, monkeypatch):
    """The values that are sorted before the shuffle come from tasks of so many records."""
    seen = []
    monkeypatch.setattr(queries, "TASK_ROWS", 50)
    monkeypatch.setattr(queries, "written", lambda df, name: seen.append((name, df.rdd.getNumPartitions())) or written(df, name))
    queries.validation_issues(spark, SF)
    assert dict(seen)["customer-values"] >= 3


def test_people_of_two_tables_are_spread(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "TASK_ROWS", 50)
    monkeypatch.setattr(queries, "written", lambda df, name: seen.append(df.rdd.getNumPartitions()) or written(df, name))
    queries._customer_values(spark, SF)
    assert seen[0] >= 4


def test_orders_and_pairs_of_names_are_dealt_by_rows(spark, monkeypatch):
    """Orders before they are normalized, and pairs of names before they are compared: both are few bytes a row."""
    monkeypatch.setattr(queries, "TASK_ROWS", 500)
    assert queries._order_people(spark, SF).rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/orders.parquet").count() // 500) >= 3
    seen = {}
    monkeypatch.setattr(resolve, "TASK_PAIRS", 5)
    monkeypatch.setattr(resolve, "written", lambda df, name: seen.update({name: df.rdd.getNumPartitions()}) or written(df, name))
    names = spark.createDataFrame([(f"s{i}", f"{first} s{i}") for i in range(12) for first in ("Jonathan", "Jonathon")], "surname string, name string").coalesce(1)
    assert resolve.similar_names(names, 90.0).count() == 12 and seen["compared-names"] == 3


def test_roots_of_one_name_tie_nothing(spark, monkeypatch):
    """The graph of names has edges of alike names and of roots with several names, not of every root."""
    seen, plain = [], linking.components
    monkeypatch.setattr(linking, "BUCKET_UNITS", 10)
    monkeypatch.setattr(linking, "components", lambda edges: seen.append(sorted(map(tuple, edges.collect()))) or plain(edges))
    units = [(i, i % 6, 0, i, 0) for i in range(6, 30)] + [(i, i, 0, i, 0) for i in range(6)] + [(40, 4, 0, 40, 1), (40, 5, 0, 41, 1)]
    similar = [(0, 1), (1, 0), (2, 3), (3, 2), *((i, i) for i in range(6))]
    got = linking.link(spark.createDataFrame(units, "root long, name long, block long, ord long, guard int"), spark.createDataFrame(similar, "name_a long, name_b long"))
    like = {a: [y for x, y in similar if x == a] for a in range(6)}
    want = linking.link_in_order(units, like)
    assert {r.root: r.cluster_id for r in got.collect()} == want and set(want.values()) == {0, 2, 4}
    assert seen[0] == [(0, 1), (2, 3), (4, 5)]


def test_phones_are_one_coalesce(spark):
    """Nested ones cost a task seconds before its first row."""
    assert "coalesce(coalesce(" not in optimized(spark.range(1).select(phone(F.col("id").cast("string"))["value"]))


def test_values_are_merged_in_tasks_of_so_many(spark, monkeypatch):
    """Scans and adaptive reads would put any number of small values into one task's sort."""
    n = 3 * 50 + 2 * 7
    rows = [(i, "CSV", f, 0, raw, "x", False) for i in range(50) for f, raw in (("full_name", f"Ada {i}"), ("emails", f"a{i % 25}@x.org"), ("skills", "Go"))]
    rows += [(100 + i, "ATS", f, 0, raw, "x", False) for i in range(7) for f, raw in (("full_name", "Bob"), ("emails", f"a{i}@x.org"))]
    raw = spark.createDataFrame(rows, "record_ord long, source string, field string, pos int, raw string, method string, malformed boolean").withColumn("edu", F.lit(None).cast(queries.normalize.EDUCATION))
    show = lambda canon: sorted(r.asDict(recursive=True).__repr__() for r in canon.collect())
    whole = show(pipeline.fuse(raw)[0])
    plans, plain = [], pipeline.written
    monkeypatch.setattr(merge, "TASK_VALUES", 20)
    monkeypatch.setattr(pipeline, "written", lambda df, name, **k: plans.append((name, optimized(df))) or plain(df, name, **k))
    assert show(pipeline.fuse(raw)[0]) == whole and len(whole) == 25
    found = dict(plans)["canonical"]
    for by in ("[record_ord#", "[cluster_id#"):
        assert any("RepartitionByExpression " + by in line and line.rstrip().endswith(f", {-(-n // 20)}") for line in found.split("\n")), found
    assert pipeline.fuse(raw.filter("record_ord < 0"))[0].count() == 0
