"""Normalizers on the cases that their rules name."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.functions import text as t


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,value,ok", [("  John.Doe@Gmail.COM ", "john.doe@gmail.com", True), ("not-an-email", "not-an-email", False)])
def test_email(spark, raw, value, ok):
    assert tuple(one(spark, t.email(F.lit(raw)))) == (value, ok)


@pytest.mark.parametrize("raw,value,ok", [("9876543210", "+919876543210", True), ("123", "123", False), ("+1 (415) 555-0123", "+14155550123", True), ("call-me-maybe", "call-me-maybe", False)])
def test_phone(spark, raw, value, ok):
    assert tuple(one(spark, t.phone(F.lit(raw)))) == (value, ok)


@pytest.mark.parametrize("raw,value,ok", [("+39 06 6982 1", "+390669821", True), ("+52 55 1234 5678", "+525512345678", True), ("+31 20 123 4567", "+31201234567", True), ("+999 1234567", "+999 1234567", False), ("+1 123 456 7890", "+1 123 456 7890", False), ("+44 12", "+44 12", False)])
def test_phone_of_other_regions(spark, raw, value, ok):
    assert tuple(one(spark, t.phone(F.lit(raw)))) == (value, ok)


@pytest.mark.parametrize("raw,code", [("HU", "HU"), ("bg", "BG"), ("Qatar", "QA"), ("PER", "PE"), (" Côte d’Ivoire ", "CI"), ("U.S.A.", "US"), ("Holland", "NL"), ("ZZ", None), ("Atlantis", None), ("", None)])
def test_country(spark, raw, code):
    assert one(spark, t.country(F.lit(raw))) == code


def test_country_table(spark):
    from tributary.functions.dims import country_codes

    assert len(set(country_codes().values())) >= 249 and all(len(c) == 2 for c in country_codes().values())


@pytest.mark.parametrize("raw,value,ok", [("Jan 2024", "2024-01", True), ("present", None, True), ("garbage-date", None, False)])
def test_month(spark, raw, value, ok):
    assert tuple(one(spark, t.month(F.lit(raw)))) == (value, ok)


@pytest.mark.parametrize("raw,value,ok", [("ML", "Machine Learning", True), ("reactjs", "React", True), ("Rust", "Rust", True), ("5+", "5+", False), ("x" * 50, "x" * 50, False), ("a b c d e f", "a b c d e f", False)])
def test_skill(spark, raw, value, ok):
    assert tuple(one(spark, t.skill(F.lit(raw)))) == (value, ok)


@pytest.mark.parametrize("raw,num,text,ok", [("5 years", 5.0, None, True), ("3.5 yrs", 3.5, None, True), ("none", None, "none", False)])
def test_years(spark, raw, num, text, ok):
    r = one(spark, t.years(F.lit(raw)))
    assert (r.value.num, r.value.text, r.ok) == (num, text, ok)


@pytest.mark.parametrize("raw,value", [("Bangalore, India", ("Bengaluru", None, "IN")), ("Bengaluru, India", ("Bengaluru", None, "IN")), ("India", (None, None, "IN")), ("Austin, Texas, US", ("Austin", "Texas", "US")), ("Remote", ("Remote", None, None))])
def test_location(spark, raw, value):
    assert tuple(one(spark, t.location(F.lit(raw))).value) == value


@pytest.mark.parametrize("raw,value,ok", [("https://www.GitHub.com/jane/", ("github", "github.com/jane", "jane"), True), ("https://github.com", ("github", "github.com", None), True), ("https://linkedin.com/in/jane-d/", ("linkedin", "linkedin.com/in/jane-d", "jane-d"), True), ("n/a", ("unknown", "n/a", None), False)])
def test_link(spark, raw, value, ok):
    r = one(spark, t.link(F.lit(raw)))
    assert (tuple(r.value), r.ok) == (value, ok)


@pytest.mark.parametrize("a,b,score", [("Jonathan Smith", "Smith Jonathan", 100.0), ("John Smith", "Jon Smith", 94.74), ("fasi owaiz ahmed", "Fasi Owaiz Ahmed", 81.25), ("Alan Turing", "Brian Turing", 78.26), ("Jane Doe", "Jane Roe", 50.0)])
def test_similarity(spark, a, b, score):
    assert one(spark, t.token_sort_ratio(F.lit(a), F.lit(b))) == pytest.approx(score, abs=0.01)


def test_candidate_id(spark):
    null = F.lit(None).cast("string")
    assert one(spark, t.candidate_id(F.lit("jane.doe@gmail.com"), null, null, null)) == "191655314d29538e"
    assert one(spark, t.candidate_id(null, null, F.lit("Only Name"), null)) == "1164246dd1d341e4"


def test_similarity_of_long_texts(spark):
    """Bits in words of 62 letters give the lengths that the table of cells gives."""
    r = random.Random(4)
    text = lambda k: "".join(r.choice("abcdé 日fghi jk"[:k]) for _ in range(r.randrange(0, 201)))
    rows = [(text(k), text(k)) for k in (2, 5, 13) for _ in range(40)] + [("x" * 62, "x" * 63), ("x" * 124, "x" * 125), ("ab" * 62, "ba" * 62), ("", ""), ("", "a")]

    def by_hand(a, b):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        row = [0] * (len(b) + 1)
        for c in a:
            last, row = row, [0]
            for j, d in enumerate(b):
                row.append(last[j] + 1 if c == d else max(last[j + 1], row[j]))
        return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", t.token_sort_ratio(F.col("a"), F.col("b")).alias("s"))
    for x in got.collect():
        assert x.s == pytest.approx(by_hand(x.a, x.b)), (x.a, x.b)


@pytest.mark.parametrize(
    "raw,code",
    [("Republic of Korea", "KR"), ("Democratic People's Republic of Korea", "KP"), ("Islamic Republic of Iran", "IR"), ("Kingdom of Norway", "NO"), ("the Federal Republic of Germany", "DE"),
     ("Ontario", "CA"), ("Bavaria", "DE"), ("Baden-Württemberg", "DE"), ("Texas", "US"), ("Georgia", "GE"), ("State of NY", None), ("Kingdom of Atlantis", None), ("Republic", None), ("Berlin", None)],
)
def test_official_names_and_regions(spark, raw, code):
    r = one(spark, t.country_result(F.lit(raw)))
    assert (r["value"], r["ok"]) == (code or raw, code is not None)


def test_emergency_codes_are_no_area_codes(spark):
    for raw, ok in (("+1 911 555 1234", False), ("+1 415 911 1234", False), ("+1 415 555 2671", True), ("+1 293 555 2671", True), ("+1 115 555 2671", False)):
        assert one(spark, t.phone(F.lit(raw), "IN"))["ok"] == ok, raw
