"""Whole runs over small inputs written by the test; results follow from the rules by hand."""

import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tributary.model import FieldMapping, ProjectionConfig
from tributary.operators.project import from_dict, project, serialize
from tributary.operators.verify import parse_handle, verify
from tributary.plans.pipeline import RunStore, project_response, run, run_response
from tributary.sources import Source, known_sources, reader
from tributary.sources.resume import parse_documents

CSV = """Candidate,Email Address,Mobile,City,Title,YOE,Skillset,GitHub,LinkedIn
Noor Haddad,noor@haddad.dev,+44 7911 123456,"Leeds, United Kingdom",Platform Engineer,7,"terraform; k8s; golang",https://github.com/noorh,https://linkedin.com/in/noor-haddad/
Teo Marquez,teo.m@correo.mx,+52 55 1234 5678,"Puebla, Mexico",QA Analyst,3,"py, cpp",,
"""
GITHUB = {"login": "noorh", "name": "Noor Haddad", "email": "noor@haddad.dev", "location": "Leeds, United Kingdom", "top_languages": ["Go", "Rust"], "pinned_repos": [{"name": "x", "language": "Zig"}]}
NOTES = "Met with Noor Haddad (noor@haddad.dev, +44 7911 123456). Solid platform engineer.\n---\nName: Teo Marquez\nSkills: Elixir\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "a.csv").write_text(CSV)
    (d / "g.json").write_text(json.dumps(GITHUB))
    (d / "n.txt").write_text(NOTES)
    (d / "bad.json").write_text("{not json")
    (d / "empty.csv").write_text("")
    return d


@pytest.fixture(scope="module")
def result(spark, files):
    return run(spark, [Source("csv", str(files / "a.csv")), Source("github", str(files / "g.json")), Source("notes", str(files / "n.txt"))])


def test_registry():
    assert known_sources() == ["ats", "ats_json", "csv", "github", "github_json", "notes", "recruiter_notes", "resume_pdf"]
    with pytest.raises(ValueError, match="unknown source"):
        reader("nope")


def test_clusters_and_confidence(result):
    rows = result.candidates.collect()
    assert [r.full_name.value for r in rows] == ["Noor Haddad", "Teo Marquez"]
    noor, teo = rows
    assert noor.candidate_id == hashlib.sha256(b"email:noor@haddad.dev").hexdigest()[:16]
    assert noor.full_name.confidence == pytest.approx(0.85) and noor.full_name.primary.source == "CSV"
    # Go is in two sources; the rest is worth what its source is
    assert [(s.value, round(s.confidence, 2)) for s in noor.skills] == [("Go", 0.85), ("Kubernetes", 0.8), ("Rust", 0.7), ("terraform", 0.8), ("Zig", 0.7)]
    assert [(x.value.kind, x.value.handle) for x in noor.links] == [("github", "noorh"), ("linkedin", "noor-haddad")]
    assert noor.headline.conflicts[0].reason == "lower_source_priority" and noor.headline.confidence == pytest.approx(0.7)
    assert [s.value for s in teo.skills] == ["C++", "Elixir", "Python"] and [p.value for p in teo.phones] == ["+525512345678"]
    assert result.stats.records_in == 5 and result.stats.clusters_out == 2


def test_reports(result):
    assert all(r.is_valid for r in result.reports.collect())


def test_broken_sources_give_nothing(spark, files):
    got = run(spark, [Source("csv", str(files / "none.csv")), Source("ats", str(files / "bad.json")), Source("csv", str(files / "empty.csv")), Source("zip", "x")])
    assert got.candidates.count() == 0 and got.reports.count() == 0


def test_projection(result):
    config = from_dict({"fields": [{"canonical": "full_name", "out": "name"}, {"canonical": "links[5]", "out": "l"}, {"canonical": "emails[0]"}, {"canonical": "location.country", "out": "c"}], "missing_value_policy": "omit"})
    out = [json.loads(r.output) for r in project(result.candidates, config).orderBy("cluster_id").collect()]
    assert out[0] == {"name": "Noor Haddad", "emails[0]": "noor@haddad.dev", "c": "GB"}
    null = ProjectionConfig(fields=(FieldMapping("links[5]", "l"),))
    assert json.loads(project(result.candidates, null).first().output) == {"l": None}
    toggled = ProjectionConfig(fields=(FieldMapping("full_name", "n"),), include_confidence=True, include_provenance=True)
    assert json.loads(project(result.candidates, toggled).orderBy("cluster_id").first().output)["n"]["sources"] == ["CSV", "GitHub", "Recruiter Note"]
    with pytest.raises(ValueError):
        from_dict({"missing_value_policy": "explode"})


def test_serialized(result):
    one = json.loads(serialize(result.candidates).orderBy("cluster_id").first().candidate)
    assert one["full_name"]["value"] == "Noor Haddad" and list(one) == sorted(one) and one["years_experience"]["value"] == 7.0


def test_verification(spark, result):
    assert parse_handle("linkedin", "https://linkedin.com/in/Jane/") == "jane" and parse_handle("github", "@jane") == "jane"
    up, found = verify(result.candidates, "linkedin", ["noor-haddad"], bonus=True)
    link = [x for x in up.orderBy("cluster_id").first().links if x.value.kind == "linkedin"][0]
    assert link.confidence == pytest.approx(0.85) and {r.code for r in found.collect()} == {"linkedin_verified"}
    down, found = verify(result.candidates, "linkedin", ["someone-else"])
    link = [x for x in down.orderBy("cluster_id").first().links if x.value.kind == "linkedin"][0]
    assert link.confidence == pytest.approx(0.7) and "linkedin_mismatch" in {r.code for r in found.collect()}
    assert verify(result.candidates, "linkedin", [])[0] is result.candidates


def test_store(result):
    store = RunStore(1)
    first = store.put(result)
    second = store.put(result)
    assert store.project(second, ProjectionConfig(fields=(FieldMapping("candidate_id", "id"),))).count() == 2
    with pytest.raises(KeyError):
        store.project(first, ProjectionConfig())


def test_store_outlives_its_session(spark, result, tmp_path, monkeypatch):
    """Another store opens the folder; a run without a manifest does not exist, and is swept; the oldest goes first."""
    folder = f"file://{tmp_path}/runs"
    first = RunStore(2, folder).put(result)
    again = RunStore(2, folder, spark.newSession())
    assert again.run_ids() == [first] and again.stats(first)["clusters_out"] == 2 and again.reports(first).count() == 2
    assert again.project(first, ProjectionConfig(fields=(FieldMapping("full_name", "n"),))).count() == 2
    with monkeypatch.context() as m:
        m.setattr(RunStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            again.put(result)
    assert again.run_ids() == [first] and len(list((tmp_path / "runs").iterdir())) >= 3
    again.sweep()
    assert {p.name for p in (tmp_path / "runs").iterdir() if not p.name.startswith(".")} == {first, again._of(first)}
    later = [again.put(result) for _ in range(2)]
    assert RunStore(2, folder, spark).run_ids() == later and not (tmp_path / "runs" / first).exists()


def test_counts_without_jobs(spark, files, monkeypatch):
    """Counts are observed while tables are written, and equal what the tables hold."""
    from tributary.operators import merge
    from tributary.plans import pipeline
    from tributary.sources import read_sources

    raw = read_sources(spark, [Source("csv", str(files / "a.csv")), Source("notes", str(files / "n.txt"))])
    stats = pipeline.RunStats()
    monkeypatch.setattr(merge, "conflict_count", None)
    canon, found = pipeline.fuse(raw, stats=stats)
    assert (stats.records_in, stats.clusters_out) == (4, 2) and canon.count() == 2 and found.count() >= 0
    assert stats.conflicts_found == canon.agg(F.sum(merge.conflicts())).first()[0]


def test_responses(result, tmp_path):
    store = RunStore()
    told = run_response(store, result)
    assert [c["full_name"]["value"] for c in told["candidates"]] == ["Noor Haddad", "Teo Marquez"] and told["stats"]["records_in"] == 5
    assert {"extract", "normalize", "resolve", "merge", "validate", "verify"} <= set(told["timings_ms"]) and len(told["validation"]) == 2
    (tmp_path / "projection_names.json").write_text(json.dumps({"fields": [{"canonical": "full_name", "out": "n"}]}))
    names = {"output": [{"n": "Noor Haddad"}, {"n": "Teo Marquez"}]}
    assert project_response(store, told["run_id"], projection_id="names", folder=str(tmp_path)) == names
    assert project_response(store, told["run_id"], {"fields": [{"canonical": "full_name", "out": "n"}]}) == names
    for error, given in ((KeyError, {"run_id": "none"}), (KeyError, {"run_id": told["run_id"], "projection_id": "none", "folder": str(tmp_path)}), (ValueError, {"run_id": told["run_id"]})):
        with pytest.raises(error):
            project_response(store, **given)


def values_of(spark, text, as_of=date(2026, 6, 15)):
    docs = spark.createDataFrame([(0, text)], "record_ord long, text string")
    out = {}
    for r in parse_documents(docs, as_of).filter("field IS NOT NULL").orderBy("field", "pos").collect():
        out.setdefault(r.field, []).append(r.edu.asDict() if r.field == "education" else r.raw)
    return out


def test_resume(spark):
    got = values_of(spark, "Jane Doe\nSenior ML Engineer\nBengaluru, India\njane@x.com | +91 98765 43210\ngithub.com/jane\nSkills: Python, Go\nLanguages: Java, C\nExperience\nAcme  Jan 2020 - Present\nBeta  Jun 2016 - Dec 2019\nEducation\nB.S. Computer Science, UT Austin (2014 to 2018)\n")
    assert got["full_name"] == ["Jane Doe"] and got["headline"] == ["Senior ML Engineer"] and got["location"] == ["Bengaluru, India"]
    assert got["emails"] == ["jane@x.com"] and got["links"] == ["github.com/jane"] and got["skills"] == ["Python", "Go", "Java", "C"]
    assert got["years_experience"] == ["10.1"]
    assert got["education"] == [{"institution": "UT Austin", "degree": "B.S. Computer Science", "field_of_study": None, "start": "2014-01", "end": "2018-01"}]
    assert values_of(spark, "A B\nExperience\nJan 2020 - Jan 2021\nJul 2020 - Jun 2021\n")["years_experience"] == ["1.5"]
    assert values_of(spark, "A B\n8 years of work\n")["years_experience"] == ["8"]


def test_order_of_fuzzy_links(spark):
    """Names link only where neither e-mails nor phones contradict."""
    from tributary.operators.normalize import normalize
    from tributary.operators.resolve import resolve

    def clusters(records):
        rows = [(i, "CSV", f, p, v, None, "m", False) for i, r in enumerate(records) for f, vs in r.items() for p, v in enumerate(vs)]
        raw = spark.createDataFrame(rows, "record_ord long, source string, field string, pos int, raw string, edu struct<institution: string, degree: string, field_of_study: string, start: string, end: string>, method string, malformed boolean")
        return [r.cluster_id for r in resolve(raw, normalize(raw)).orderBy("record_ord").collect()]

    a, b = {"full_name": ["John Smith"], "emails": ["a@x.com"]}, {"full_name": ["John Smith"], "emails": ["b@x.com"]}
    assert clusters([a, b]) == [0, 1]
    assert clusters([a, {"full_name": ["Jon Smith"]}]) == [0, 0]
    assert clusters([{"full_name": ["Jane Doe"]}, {"full_name": ["Jane Roe"]}]) == [0, 1]
    assert clusters([a, {"full_name": ["John Smith"]}, b]) == [0, 0, 2]
    assert clusters([{"emails": ["a@x.com"]}, {"emails": ["a@x.com", "b@x.com"]}, {"emails": ["b@x.com"]}]) == [0, 0, 0]
