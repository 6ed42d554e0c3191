"""Checking profile handles against handles given by the user: confidence goes up on a match and down on a mismatch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import clamp, record_confidence

LABEL = {"linkedin": "LinkedIn", "github": "GitHub"}
BONUS, PENALTY = 0.05, 0.10


def parse_handle(kind: str, raw: str) -> str | None:
    """The handle in an address or a bare name; None if there is none."""
    t = raw.strip().lower()
    if not t:
        return None
    if "/" in t and ".com" in t:
        path = [p for p in re.sub(r"^https?://", "", t).split("/") if p][1:]
        if kind == "linkedin":
            at = next((i for i, p in enumerate(path) if p in ("in", "pub") and i + 1 < len(path)), None)
            return None if at is None else path[at + 1]
        return path[0] if path else None
    t = t.strip("/").lstrip("@")
    if kind == "linkedin":
        t = re.sub(r"^(?:in|pub)/", "", t)
    return t.split("/")[0] or None


def _sources(tv: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.array(tv["primary"]["source"]), F.transform(tv["agreements"], lambda a: a["source"]))))


def record_handle(kind: str, exclude_source: str | None) -> Column:
    """A row's own handle: from a resume if one has it, else the first; not from links that only the excluded source has."""
    mine = F.filter("links", lambda tv: (tv["value"]["kind"] == kind) & tv["value"]["handle"].isNotNull())
    if exclude_source:
        mine = F.filter(mine, lambda tv: _sources(tv) != F.array(F.lit(exclude_source)))
    resume = F.filter(mine, lambda tv: F.array_contains(_sources(tv), "Resume"))
    return F.coalesce(F.get(resume, F.lit(0))["value"]["handle"], F.get(mine, F.lit(0))["value"]["handle"])


def verify(canon: DataFrame, kind: str, provided: list[str], exclude_source: str | None = None, bonus: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows with adjusted links, and the issues: verified, mismatch or unverified."""
    handles = sorted({h for h in (parse_handle(kind, p) for p in provided) if h})
    none = canon.select("cluster_id", "candidate_id", F.lit("links").alias("field"), F.lit("").alias("code"), F.lit("").alias("message"), F.lit("info").alias("severity")).limit(0)
    if not handles:
        return canon, none
    rows = canon.withColumn("__handle", record_handle(kind, exclude_source)).withColumn("__match", F.coalesce(F.col("__handle").isin(*handles), F.lit(False)))
    any_match = rows.agg(F.max("__match")).first()[0] or False
    label = LABEL.get(kind, kind)
    mark = F.struct(F.lit(label).alias("source"), F.lit(f"{kind}_verify").alias("method"), F.lit("").alias("raw"), F.lit(False).alias("malformed"), F.lit(1).alias("n"))

    def verified(tv: Column) -> Column:
        new = F.array_contains(_sources(tv), label)
        up = tv.withField("confidence", clamp(tv["confidence"] + BONUS)).withField("agreements", F.array_sort(F.array_append(tv["agreements"], mark)))
        return F.when((tv["value"]["kind"] == kind) & tv["value"]["handle"].isin(*handles) & ~new, up).otherwise(tv)

    def doubted(tv: Column) -> Column:
        return F.when(tv["value"]["kind"] == kind, tv.withField("confidence", clamp(tv["confidence"] - PENALTY))).otherwise(tv)

    differs = F.col("__handle").isNotNull() & ~F.col("__match") & F.lit(not any_match)
    links = F.when(F.col("__match") & F.lit(bonus), F.transform("links", verified)).when(differs, F.transform("links", doubted)).otherwise(F.col("links"))
    code = F.when(F.col("__match"), f"{kind}_verified").when(differs, f"{kind}_mismatch").when(F.col("__handle").isNull() & F.lit(not any_match), f"{kind}_unverified")
    found = rows.withColumn("code", code).filter("code IS NOT NULL").select(
        "cluster_id", "candidate_id", F.lit("links").alias("field"), "code",
        F.concat(F.lit(f"{label} handle "), F.coalesce("__handle", F.lit("none")), F.lit(", given "), F.lit(", ".join(handles))).alias("message"),
        F.when(differs, "warning").otherwise("info").alias("severity"),
    )
    return rows.withColumn("links", links).drop("__handle", "__match").withColumn("record_confidence", record_confidence()), found
