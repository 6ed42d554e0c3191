"""Fusion rules on hand-made values, and their independence of partitioning."""

import pytest

from tributary.model import RAW_VALUES, FusionConfig
from tributary.operators import merge, normalize, validate
from tributary.operators.components import components
from tributary.operators.project import serialize


def fused(spark, values, parts=None, config=FusionConfig()):
    """values: (record_ord, source, field, raw); all records are one cluster."""
    rows = [(o, s, f, 0, x, None, "m", False) for o, s, f, x in values]
    raw = spark.createDataFrame(rows, RAW_VALUES)
    if parts:
        raw = raw.repartition(parts)
    clusters = raw.selectExpr("record_ord", "0L AS cluster_id").distinct()
    return merge.canonical(merge.tracked(normalize.normalize(raw, config), clusters), clusters, config)


def test_priority_and_conflict(spark):
    c = fused(spark, [(0, "Resume", "headline", "A"), (1, "CSV", "headline", "Longer")]).first()
    assert c.headline.value == "A" and c.headline.confidence == pytest.approx(0.8) and c.headline.conflicts[0].reason == "lower_source_priority"


def test_agreement(spark):
    c = fused(spark, [(0, "Resume", "full_name", "Jane"), (1, "CSV", "full_name", "Jane")]).first()
    assert c.full_name.confidence == pytest.approx(0.95) and [a.source for a in c.full_name.agreements] == ["CSV"]


def test_equal_rows_are_counted_not_listed(spark):
    values = [(0, "Resume", "headline", "A")] + [(i, "CSV", "headline", "A" if i % 2 else "B") for i in range(1, 41)]
    canon = fused(spark, values)
    c = canon.first().headline
    assert [(a.source, a.n) for a in c.agreements] == [("CSV", 20)]
    assert [(x.value, x.source.source, x.reason, x.n) for x in c.conflicts] == [("B", "CSV", "lower_source_priority", 20)]
    assert c.confidence == pytest.approx(0.85) and merge.conflict_count(canon) == 20
    assert serialize(canon).first().candidate.count("lower_source_priority") == 20


def test_malformed(spark):
    c = fused(spark, [(0, "Resume", "emails", "nope"), (0, "Resume", "skills", "12345")]).first()
    assert c.emails[0].confidence == pytest.approx(0.7) and c.skills[0].confidence == pytest.approx(0.6)


def test_tie(spark):
    c = fused(spark, [(0, "CSV", "headline", "zeta"), (1, "CSV", "headline", "beta")]).first()
    assert c.headline.value == "beta" and c.headline.conflicts[0].reason == "tiebreak_lost"


def test_text_years_beat_a_number_by_length(spark):
    c = fused(spark, [(0, "CSV", "years_experience", "five years"), (1, "CSV", "years_experience", "7")]).first()
    assert c.years_experience.value.text == "five years" and c.years_experience.conflicts[0].value.num == 7.0


def test_completeness(spark):
    assert fused(spark, [(0, "CSV", "full_name", "Only Name")]).first().record_confidence == pytest.approx(0.65)
    assert fused(spark, [(0, "CSV", "full_name", "A"), (0, "CSV", "skills", "Go")]).first().completeness_penalty == 0.0


def test_any_partitioning(spark):
    values = [(i, s, f, x) for i, (s, x) in enumerate([("CSV", "a"), ("ATS", "bb"), ("Resume", "a"), ("GitHub", "c"), ("ATS", "a")]) for f in ("headline", "skills", "full_name")]
    want = fused(spark, values).collect()
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = fused(spark, values, n).collect()
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_issues(spark):
    c = fused(spark, [(0, "CSV", "emails", "nope"), (0, "CSV", "phones", "123"), (0, "CSV", "full_name", "A")])
    found = validate.issues(c)
    assert sorted((r.field, r.code, r.severity) for r in found.collect()) == [("emails", "email_format", "error"), ("emails", "malformed", "warning"), ("phones", "malformed", "warning"), ("phones", "phone_format", "error")]
    assert not validate.reports(c, found).first().is_valid


@pytest.mark.parametrize("small", [10**6, 0])
def test_components(spark, small, monkeypatch):
    import tributary.operators.components as m

    monkeypatch.setattr(m, "SMALL_EDGES", small)
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 50, 50: 50, 70: 50}
