"""Checks of canonical rows: one row per issue, and a report per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMAIL
from ..model import COLLECTIONS, SCALARS

ISSUE = "STRUCT<issue_ord: INT, field: STRING, code: STRING, message: STRING, severity: STRING>"


def _issue(order: int, field: str, code: str, message: Column, severity: str) -> Column:
    return F.struct(F.lit(order).alias("issue_ord"), F.lit(field).alias("field"), F.lit(code).alias("code"), message.cast("string").alias("message"), F.lit(severity).alias("severity"))


def _when(condition: Column, issue: Column) -> Column:
    return F.filter(F.array(F.when(F.coalesce(condition, F.lit(False)), issue)), lambda i: i.isNotNull())


def _each(items: Column, bad, issue) -> Column:
    return F.transform(F.filter(items, lambda x: F.coalesce(bad(x), F.lit(False))), issue)


def quoted(x: Column) -> Column:
    return F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _of_value(items: Column, f: str) -> list[Column]:
    wide = _each(items, lambda tv: ~tv["confidence"].between(0, 1), lambda tv: _issue(1, f, "confidence_range", F.concat(F.lit("confidence outside [0, 1]: "), tv["confidence"].cast("string")), "error"))
    malformed = _each(items, lambda tv: tv["primary"]["malformed"], lambda tv: _issue(1, f, "malformed", F.concat(F.lit("malformed value: "), quoted(tv["primary"]["raw"])), "warning"))
    return [wide, malformed]


def _bad_date(end: str) -> Column:
    return _each(F.col("education"), lambda tv: tv["value"][end].isNotNull() & ~tv["value"][end].rlike(r"^\d{4}-\d{2}$"), lambda tv: _issue(5, "education", "date_format", F.concat(F.lit("not YYYY-MM: "), tv["value"][end]), "error"))


def _repeated(f: str) -> Column:
    vs = F.transform(F.col(f), lambda tv: tv["value"])
    again = F.filter(F.transform(vs, lambda v, i: F.when(F.array_position(vs, v) < i + 1, v)), lambda v: v.isNotNull())
    return F.transform(again, lambda v: _issue(6, f, "duplicate", F.concat(F.lit("more than once: "), v), "warning"))


def issues(canon: DataFrame) -> DataFrame:
    """cluster_id, candidate_id and the issues, numbered in the order of checks."""
    found = [_when(F.coalesce("candidate_id", F.lit("")) == "", _issue(0, "candidate_id", "missing_id", F.lit("candidate has no id"), "error"))]
    for f in (*SCALARS, *COLLECTIONS):
        items = F.filter(F.array(F.col(f)), lambda tv: tv.isNotNull()) if f in SCALARS else F.col(f)
        found += _of_value(items, f)
    found.append(_each(F.col("emails"), lambda tv: ~tv["value"].rlike(EMAIL), lambda tv: _issue(2, "emails", "email_format", F.concat(F.lit("not an e-mail address: "), tv["value"]), "error")))
    found.append(_each(F.col("phones"), lambda tv: ~tv["value"].rlike(r"^\+\d{7,15}$"), lambda tv: _issue(3, "phones", "phone_format", F.concat(F.lit("not an E.164 number: "), tv["value"]), "error")))
    country = F.col("location")["value"]["country"]
    found.append(_when(country.isNotNull() & ~country.rlike("^[A-Z]{2}$"), _issue(4, "location", "country_format", F.concat(F.lit("not a country code: "), country), "warning")))
    found += [_bad_date(end) for end in ("start", "end")]
    found += [_repeated(f) for f in ("emails", "phones", "skills")]
    # a field's issues come value by value, so equal orders keep the order of fields
    listed = F.flatten(F.array(*found))
    return canon.select("cluster_id", "candidate_id", F.explode(listed).alias("i")).select("cluster_id", "candidate_id", "i.*")


def reports(canon: DataFrame, found: DataFrame) -> DataFrame:
    """cluster_id, candidate_id, is_valid (no error) and the issues sorted by severity, field and code."""
    one = F.struct("severity", "field", "code", "issue_ord", "message")
    got = found.groupBy("cluster_id").agg(F.array_sort(F.collect_list(one)).alias("issues"), F.max(F.col("severity") == "error").alias("bad"))
    return canon.select("cluster_id", "candidate_id").join(got, "cluster_id", "left").select("cluster_id", "candidate_id", (~F.coalesce("bad", F.lit(False))).alias("is_valid"), F.coalesce("issues", F.array().cast(got.schema["issues"].dataType)).alias("issues"))
