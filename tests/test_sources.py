"""Readers over folders of several files, and what they take from each record."""

import random
import csv
import json
from datetime import date

import pytest

from tributary.plans.pipeline import run
from tributary.sources import Source, json_profiles, read_sources, reader, resume


def taken(rows):
    """Values by record in the order of records: field to list of raw values."""
    out = {}
    for r in rows.orderBy("record_ord", "field", "pos").collect():
        of = out.setdefault(r.record_ord, {})
        if r.field:
            of.setdefault(r.field, []).append(r.edu.asDict() if r.field == "education" else r.raw)
    return list(out.values())


def put(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / name.replace("__", " ").replace("_", ".")).write_text(text if isinstance(text, str) else json.dumps(text))
    return str(folder)


def test_csv_folder(spark, tmp_path):
    """Each file has its own header, wherever it stands; a byte order mark and breaks inside quotes are no matter."""
    d = put(tmp_path / "csv", b__1_csv='\ufeffName,E-Mail,email,note\n"Ann, A",x,a@x.org,"two\nlines"\n , , ,only a note\nBob,,b@x.org,\n', a_csv="other,Candidate Name,SKILLS,github,portfolio\n1,Cid,ml;go, , cid.dev \n")
    assert taken(reader("csv")(spark, d)) == [{"full_name": ["Cid"], "skills": ["ml", "go"], "links": ["cid.dev"]}, {"full_name": ["Ann, A"], "emails": ["a@x.org"]}, {"full_name": ["Bob"], "emails": ["b@x.org"]}]
    for text in ("", "foo,bar\n1,2\n", "name,email\n"):
        (tmp_path / "one.csv").write_text(text)
        assert taken(reader("csv")(spark, str(tmp_path / "one.csv"))) == []


def test_csv_in_splits(spark, tmp_path):
    """Files without breaks inside quotes are cut; the order of rows stays that of the file."""
    rows = [f"p{i},p{i}@x.org" for i in range(3000)]
    d = put(tmp_path / "csv", a_csv="name,email\n" + "\n".join(rows[:2000]), b_csv="name,email\n" + "\n".join(rows[2000:]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = reader("csv")(spark, d)
        assert got.rdd.getNumPartitions() > 3
        assert [x["full_name"][0] for x in taken(got)] == [f"p{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ats_folder(spark, tmp_path):
    ann = {"fullName": " Ann ", "currentTitle": "", "title": "Cook", "yearsExperience": None, "years_experience": 9, "email": "a@x.org", "phone": 5551234, "location": {"city": "Lima", "region": "", "country": "Peru"}, "skills": ["Go", " ", "SQL"], "links": {"web": "ann.dev", "x": ""}}
    bob = {"name": "Bob", "headline": "Baker", "years_experience": 2.5, "location": " Oslo ", "skills": "Go, SQL", "links": ["b.dev", "b.dev"]}
    d = put(tmp_path / "ats", a_json={"candidates": [ann, 3, {}]}, b_json=[bob], c_json={"name": "Cid"})
    assert taken(reader("ats")(spark, d)) == [
        {"full_name": ["Ann"], "headline": ["Cook"], "emails": ["a@x.org"], "phones": ["5551234"], "location": ["Lima, Peru"], "skills": ["Go", "SQL"], "links": ["ann.dev"]},
        {"full_name": ["Bob"], "headline": ["Baker"], "years_experience": ["2.5"], "location": ["Oslo"], "links": ["b.dev"]},
        {"full_name": ["Cid"]},
    ]


def test_github_folder_and_login(spark, tmp_path, monkeypatch):
    d = put(tmp_path / "gh", a_json={"login": "ann", "blog": "ann.dev", "top_languages": ["Go", "Go"], "pinned_repos": [{"language": "C"}, {"name": "x"}]}, b_json={"login": "bob", "html_url": "https://github.com/Bob", "name": "Bob"})
    assert taken(reader("github")(spark, d)) == [{"links": ["https://github.com/ann", "ann.dev"], "skills": ["Go", "C"]}, {"full_name": ["Bob"], "links": ["https://github.com/Bob"]}]
    assert taken(reader("github")(spark, "https://github.com/eve/repo")) == [{"links": ["https://github.com/eve"]}]
    monkeypatch.setattr(json_profiles, "fetch_profile", lambda login: json.dumps({"login": login, "name": "Eve"}))
    assert taken(reader("github")(spark, "@eve")) == [{"full_name": ["Eve"], "links": ["https://github.com/eve"]}]


def test_notes_folder(spark, tmp_path):
    d = put(tmp_path / "notes", a_txt="Name: Ann\nGitHub: @ann\nSkills: Go, SQL;\n\nname: Bob\n", b_txt="Name: Cid\n\nTel: 5551234567\n***\nTalked to Dee Moss, backend engineer, dee@x.org, Scala and Spark\n")
    assert taken(reader("notes")(spark, d)) == [
        {"full_name": ["Ann"], "links": ["github.com/ann"], "skills": ["Go", "SQL"]}, {"full_name": ["Bob"]}, {"full_name": ["Cid"], "phones": ["5551234567"]},
        {"full_name": ["Dee Moss"], "headline": ["backend engineer"], "emails": ["dee@x.org"], "skills": ["Scala", "Spark"]},
    ]


def test_resumes_in_the_order_of_files(spark, tmp_path, monkeypatch):
    d = put(tmp_path / "cv", b_txt="Bob Stone\nBaker\n", a_txt="Ann Wood\nTechnical Skills\nGo | SQL\nTools: Git, Make\nProjects\nNot a skill\n")
    assert taken(reader("resume_pdf")(spark, f"{d}/*.txt")) == [{"full_name": ["Ann Wood"], "skills": ["Go", "SQL", "Git", "Make"]}, {"full_name": ["Bob Stone"]}]
    assert taken(reader("resume_pdf")(spark, d)) == []  # no decoder
    monkeypatch.setattr(resume, "decode_pdf", lambda content: content.decode().split("\n", 1))
    assert [x["full_name"] for x in taken(reader("resume_pdf")(spark, d))] == [["Ann Wood"], ["Bob Stone"]]


def test_resume_places_and_dates(spark):
    """A labelled list is no place; overlapping jobs count once; a school's single year stands for both ends or none."""
    text = "Ann Wood\nBackend: node.js, Rust\nSenior Engineer\nOslo, Norway\nWork Experience\nA 2015 - 2017\nB 03/2016 - present\nEducation\nMSc Maths, UNI X, 2009 - 2011\n"
    got = taken(resume.parse_documents(spark.createDataFrame([(5, text)], "record_ord long, text string"), date(2018, 2, 1)))[0]
    assert got["location"] == ["Oslo, Norway"] and got["headline"] == ["Senior Engineer"]
    assert got["years_experience"] == ["3.2"]  # January 2015 to February 2018: 38 months
    assert got["education"] == [{"institution": "UNI X", "degree": "MSc Maths", "field_of_study": None, "start": "2009-01", "end": "2011-01"}]


def test_diagnosis(spark):
    docs = spark.createDataFrame([(1, "Ann Wood\n\nSkills: Go\nEducation\n UNI \nProjects\n")], "record_ord long, text string")
    got = [(r.line_no, r.line, r.tag) for r in resume.diagnose(docs).orderBy("line_no").collect()]
    assert got == [(0, "Ann Wood", None), (2, "Skills: Go", "skills header"), (3, "Education", "education header"), (4, "UNI", None), (5, "Projects", "section header")]


def test_strangers_of_a_folder_stay_apart(spark, tmp_path):
    d = put(tmp_path / "ats", a_json=[{"name": "Ann Wood", "email": "a@x.org"}], b_json=[{"name": "Bob Stone", "email": "b@x.org"}])
    n = put(tmp_path / "notes", a_txt="Name: Cid Moss\nEmail: c@x.org\n", b_txt="Name: Dee Lake\nEmail: a@x.org\n")
    got = run(spark, [Source("ats", d), Source("notes", n)]).candidates.collect()
    assert [(r.full_name.value, [e.value for e in r.emails]) for r in got] == [("Ann Wood", ["a@x.org"]), ("Bob Stone", ["b@x.org"]), ("Cid Moss", ["c@x.org"])]


def test_a_source_that_fails_late_gives_nothing(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tributary.sources import registry

    rows = reader("csv")(spark, put(tmp_path / "csv", a_csv="name\n" + "\n".join(f"p{i}" for i in range(50))))
    bad = rows.withColumn("raw", F.when(F.col("raw") == "p40", F.raise_error(F.lit("bad row")).cast("string")).otherwise(F.col("raw")))
    monkeypatch.setitem(registry._READERS, "late", lambda spark, path: bad)
    assert read_sources(spark, [Source("late", "x"), Source("csv", str(tmp_path / "csv"))]).filter("field IS NOT NULL").count() == 50
    with pytest.raises(ValueError):
        read_sources(spark, [Source("csv", "x")] * (registry.MAX_SOURCES + 1))


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "6000")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_json_arrays_in_splits(spark, tmp_path, small_splits):
    """Objects that cross splits, brackets and quotes inside strings, files that are not whole."""
    from tributary.sources import json_profiles, splits

    r = random.Random(1)
    objs = [{"name": f"P {i}", "note": r.choice(['has } and { and ] "quoted" \\ back\\', "x" * r.randrange(900), "é日\n", "plain"]) + str(i), "skills": ["a]", "{b"], "k": {"z": [{"y": 1}]}} for i in range(120)]
    texts = {
        "a": json.dumps(objs),
        "b": "\n [ " + ",\n".join(json.dumps(o, indent=1) for o in objs[:20]) + "\n]\n",
        "c": json.dumps(objs)[:-1],
        "d": json.dumps(objs[0]),
        "e": json.dumps({"candidates": objs[:3], "other": [{"a": 1}]}),
        "f": json.dumps(objs[:5]).replace('"P 1"', "P 1"),
        "g": "[]",
        "h": json.dumps([1, "x{", [{"inner": 2}], objs[7], None]),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert splits.chunks(spark, str(tmp_path / "a.json"), splits.JsonArrayScan()).rdd.getNumPartitions() > 4
    want = {"a": objs, "b": objs[:20], "c": [], "d": objs[:1], "e": objs[:3], "f": [], "g": [], "h": [objs[7]]}
    got = json_profiles._objects(spark, str(tmp_path), "candidates").orderBy("record_ord").collect()
    assert [json.loads(x.obj) for x in got] == [o for name in sorted(want) for o in want[name]]
    assert len({x.record_ord for x in got}) == len(got)


def test_quoted_line_breaks_in_splits(spark, tmp_path, small_splits):
    from tributary.sources.csv import read_csv

    r = random.Random(2)
    rows = [["name", "email", "title"]] + [[f"N {i}", f"n{i}@x.org", r.choice(["plain", "li\nne\n\nmore", 'q"uo"te, and\n"', "a,b", "long " * 200 + "\n"]) + "."] for i in range(150)]
    with open(tmp_path / "x.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
        f.write('Odd,odd@x.org,5" disk\nLast,last@x.org,end\n')  # a quote inside a cell opens nothing
    rows += [["Odd", "odd@x.org", '5" disk'], ["Last", "last@x.org", "end"]]
    got = read_csv(spark, str(tmp_path / "x.csv")).filter("field IN ('full_name', 'headline')").orderBy("record_ord").collect()
    assert [x.raw for x in got if x.field == "full_name"] == [x[0] for x in rows[1:]]
    assert [x.raw for x in got if x.field == "headline"] == [x[2].strip() for x in rows[1:]]
