"""Nested JSON exports: applicant-tracking systems and GitHub profiles."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import none_if_blank
from ..plans.storage import written
from . import splits
from .registry import FILE, files_of, in_order, many, one, register, values


def _get(obj: Column, key: str) -> Column:
    return F.get_json_object(obj, f"$.{key}")


def _clean(obj: Column, *keys: str) -> Column:
    """The first of the keys whose value is not blank."""
    return F.coalesce(*(none_if_blank(_get(obj, k)) for k in keys))


def _is(x: Column, opening: str) -> Column:
    return F.coalesce(F.ltrim(x).startswith(opening), F.lit(False))


def _array(x: Column) -> Column:
    return F.from_json(x, "array<string>")


def _texts(x: Column) -> Column:
    """Non-blank values of an array or of a map, each once, in their order."""
    found = F.when(_is(x, "["), _array(x)).when(_is(x, "{"), F.map_values(F.from_json(x, "map<string,string>")))
    found = F.transform(F.coalesce(found, F.array().cast("array<string>")), none_if_blank)
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull()))


def _objects(spark: SparkSession, path: str, wrapper: str | None) -> DataFrame:
    """record_ord and obj of the objects in a file's array, in its wrapper's array, or of the one object that it is.

    Files that are arrays are read in splits, the others as one row each, below 2 GB. A file that is not whole, or with an
    object that is not JSON, gives no records.
    """
    scan = splits.JsonArrayScan()
    chunks = splits.chunks(spark, path, scan)
    files = files_of(chunks)
    first = chunks.filter("block = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("value"))
    arrays = {r["file"] for r in first.filter(F.col("value").rlike(r"^\s*\[")).select("file").collect()}  # a row a file, as files_of gives
    rows = None
    open_path = lambda f: spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)).toString()
    if arrays:
        found, end = splits.records(splits.chunks(spark, [open_path(f) for f in sorted(arrays)], scan), scan)
        good = [f for f in sorted(arrays) if end[f] == -2]  # what follows the last bracket counts as one more
        found = written(found.filter(F.col("file").isin(good)), "json-objects")
        broken = found.filter(F.json_object_keys("text").isNull()).select("file").distinct()
        rows = found.join(broken, "file", "left_anti").select("file", "at", F.col("text").alias("obj"))
    others = [f for f, _ in files if f not in arrays]
    if others or rows is None:
        text = spark.read.text([open_path(f) for f in others] or path, wholetext=True).select("value", F.col(FILE).alias("file"))
        whole = F.col("value")
        inner = _get(whole, wrapper) if wrapper else F.lit(None).cast("string")
        items = F.when(_is(inner, "["), _array(inner)).when(_is(whole, "{") & inner.isNull(), F.array(whole))
        single = text.select("file", F.posexplode(items).alias("at", "obj")).filter(_is(F.col("obj"), "{")).filter(F.json_object_keys("obj").isNotNull())
        single = single.select("file", F.col("at").cast("long").alias("at"), "obj")
        rows = single if rows is None else rows.unionByName(single)
    return in_order(rows, files).select("record_ord", "obj")


def _place(x: Column) -> Column:
    parts = F.concat_ws(", ", *(none_if_blank(_get(x, k)) for k in ("city", "region", "state", "country")))
    return F.when(_is(x, "{"), F.nullif(parts, F.lit(""))).otherwise(none_if_blank(x))


@register("ats_json", "ats")
def read_ats(spark: SparkSession, path: str) -> DataFrame:
    return ats_values(_objects(spark, path, "candidates"))


def ats_values(rows: DataFrame) -> DataFrame:
    """RAW_VALUES of candidates (record_ord, obj: JSON text)."""
    m = "ats_json"
    keys = ("fullName", "name", "currentTitle", "title", "headline", "email", "phone")
    plain = ("yearsExperience", "years_experience", "location", "skills", "links")
    # each key is looked up once, into a column of its own: the expressions below use it several times
    got = rows.select("record_ord", F.array_contains(F.json_object_keys("obj"), "yearsExperience").alias("has"), *(_get(F.col("obj"), k).alias(f"_{k}") for k in (*keys, *plain)))
    place = [_get(F.col("_location"), k).alias(f"_in_{k}") for k in ("city", "region", "state", "country")]
    got = got.select("*", *place)
    text = lambda *ks: F.coalesce(*(none_if_blank(F.col(f"_{k}")) for k in ks))
    at, skills = F.col("_location"), F.col("_skills")
    parts = F.concat_ws(", ", *(none_if_blank(F.col(f"_in_{k}")) for k in ("city", "region", "state", "country")))
    return values(got, "ATS", [
        one("full_name", text("fullName", "name"), m),
        one("headline", text("currentTitle", "title", "headline"), m),
        one("years_experience", F.when(F.col("has"), text("yearsExperience")).otherwise(text("years_experience")), m),
        one("emails", text("email"), m),
        one("phones", text("phone"), m),
        one("location", F.when(_is(at, "{"), F.nullif(parts, F.lit(""))).otherwise(none_if_blank(at)), m),
        many("skills", F.filter(F.transform(F.coalesce(_array(F.when(_is(skills, "["), skills)), F.array().cast("array<string>")), none_if_blank), lambda s: s.isNotNull()), m),
        many("links", _texts(F.col("_links")), m),
    ], filled=True)


def profile_values(rows: DataFrame) -> DataFrame:
    o = F.col("obj")
    m = "github_api"
    page = F.coalesce(_clean(o, "html_url"), F.concat(F.lit("https://github.com/"), _clean(o, "login")))
    repos = F.transform(F.coalesce(_array(_get(o, "pinned_repos")), F.array().cast("array<string>")), lambda r: none_if_blank(_get(r, "language")))
    skills = F.concat(F.transform(F.coalesce(_array(_get(o, "top_languages")), F.array().cast("array<string>")), none_if_blank), repos)
    return values(rows, "GitHub", [
        one("full_name", _clean(o, "name"), m),
        one("emails", _clean(o, "email"), m),
        one("location", _clean(o, "location"), m),
        many("links", F.array_distinct(F.array_compact(F.array(page, _clean(o, "blog")))), m),
        many("skills", F.array_distinct(F.array_compact(skills)), m),
    ], filled=True)


def login_of(source: str) -> str | None:
    """The login in a profile address or a bare user name; None for anything else."""
    found = re.search(r"github\.com/([^/?#]+)", source, re.I)
    if found:
        return found[1]
    bare = source.strip().removeprefix("@")
    return bare if re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})", bare) else None


#: Fetches a profile's JSON text by login, or None. There is no network by default; callers set their own.
fetch_profile: Callable[[str], str | None] = lambda login: None


def login_for_verification(source: str) -> str | None:
    return None if os.path.exists(source) else login_of(source)


@register("github", "github_json")
def read_github(spark: SparkSession, source: str) -> DataFrame:
    is_url = re.match(r"https?://", source, re.I) or "github.com/" in source.lower()
    login = None if not is_url and (os.path.exists(source) or "/" in source or "." in source) else login_of(source)
    if login is None:
        return profile_values(_objects(spark, source, None))
    text = fetch_profile(login)
    if text:
        return profile_values(spark.createDataFrame([(0, text)], "record_ord long, obj string").filter(_get(F.col("obj"), "login").isNotNull()))
    rows = spark.createDataFrame([(0,)], "record_ord long")  # what the name alone tells
    return values(rows, "GitHub", [many("links", F.array(F.lit(f"https://github.com/{login}")), "github_url")])
