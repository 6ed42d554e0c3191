"""A source of one's own, read by eight tasks."""

import pytest

from tributary.plans.pipeline import run
from tributary.sources import Source, read_sources, registry
from tributary.sources.datasource import RecordSource, register_source


def directory_source():
    """A class of a function is sent to workers whole: they cannot import tests."""

    class Directory(RecordSource):
        source, method = "ATS", "directory"

        @classmethod
        def name(cls):
            return "directory"

        def slices(self):
            return list(range(int(self.options.get("path", "8").rsplit("/", 1)[-1])))

        def records(self, part):
            for k in range(3):
                yield {"full_name": f"Person {part} {k}", "emails": [f"p{part}.{k}@x.org", " "], "skills": ["py", "k8s"], "education": [{"institution": "U", "degree": "BSc"}] if k == 0 else []}
            yield {"headline": None, "colour": "red"} if part == 99 else {"headline": None}

    return Directory


@pytest.fixture
def directory(spark):
    register_source(spark, directory_source(), "ldap")
    yield
    for name in ("directory", "ldap"):
        registry._READERS.pop(name)


def test_read_in_parallel(spark, directory):
    rows = spark.read.format("directory").load("host/8")
    assert rows.rdd.getNumPartitions() == 8
    raw = read_sources(spark, [Source("directory", "host/8"), Source("ldap", "host/2"), Source("ldap", "host/100")])  # the last fails late: no rows of it
    assert raw.select("record_ord").distinct().count() == 4 * 8 + 4 * 2
    names = [r.raw for r in raw.filter("field = 'full_name'").orderBy("record_ord").collect()]
    assert names == [f"Person {p} {k}" for n in (8, 2) for p in range(n) for k in range(3)]
    assert raw.filter("field = 'education'").select("edu.degree").distinct().collect()[0].degree == "BSc"


def test_run(spark, directory):
    """Both registrations give the same people: they meet by their e-mails."""
    got = run(spark, [Source("directory", "host/2"), Source("ldap", "host/2")])
    people = [r for r in got.candidates.collect() if r.full_name]
    assert len(people) == 6 and [s.value for s in people[0].skills] == ["Kubernetes", "Python"] and people[0].emails[0].value == "p0.0@x.org"
