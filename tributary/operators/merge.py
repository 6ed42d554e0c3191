"""Fusion: the values of a cluster become one row whose every value has its source, confidence, agreements and conflicts.

Winners are found by an aggregate (which combines before the shuffle) and joined back; lists are sorted by total orders,
so the result does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import candidate_id
from ..model import AGREEMENT_BONUS, COLLECTIONS, COMPLETENESS_PENALTY, CONFLICT_PENALTY, MALFORMED_PENALTY, SCALARS, SKILL_MALFORMED_PENALTY, FusionConfig

VALUE_OF = {"full_name": "v_str", "headline": "v_str", "location": "v_loc", "emails": "v_str", "phones": "v_str", "skills": "v_str", "links": "v_link", "education": "v_edu"}


#: Values that one task merges, where their number is known: some 600 bytes each are sorted at once.
TASK_VALUES = 50_000


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """The rows in so many tasks, or as they lie: scans and adaptive reads are cut by compressed bytes, which hold any number of values."""
    return rows.repartition(tasks, *by) if tasks else rows


def dec(x: str) -> Column:
    return F.lit(x).cast("decimal(6,4)")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(1), x))


def confidence(base: Column, agreed: Column, contested: Column, malformed: Column, penalty: Column) -> Column:
    """Base of the source, plus a bonus if any source agrees, less a penalty if any differs, less one for a malformed value."""
    zero = dec("0")
    return clamp(base + F.when(agreed, dec(AGREEMENT_BONUS)).otherwise(zero) - F.when(contested, dec(CONFLICT_PENALTY)).otherwise(zero) - F.when(malformed, penalty).otherwise(zero)).cast("double")


def win_order() -> list[Column]:
    """What decides among values: source priority, completeness, then the written form, then input order."""
    return [(-F.col("priority")).alias("o1"), (-F.col("completeness")).alias("o2"), F.col("tiebreak").alias("o3"), F.col("record_ord").alias("o4"), F.col("pos").alias("o5")]


def compared(values: DataFrame, clusters: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct values of each (cluster_id, field, g) with the winner w, and how many rows agree with it and differ from it.

    Equal rows are counted before they meet their winner, so a cluster that holds much of the table is combined where it
    lies. The winner's own row counts neither way.
    """
    group = F.when(F.col("field").isin(*SCALARS), F.lit("")).otherwise(F.col("v_key")).alias("g")
    value = ("v_key", "priority", "completeness", "tiebreak", "base", "source", "method", "raw", "malformed", "v_str", "v_num", "v_loc", "v_link", "v_edu")
    at = F.struct("record_ord", "pos")
    v = dealt(values, tasks, "record_ord").join(clusters, "record_ord").groupBy("cluster_id", "field", group, *value).agg(F.min(at).alias("at"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    v = dealt(v.withColumn("record_ord", F.col("at.record_ord")).withColumn("pos", F.col("at.pos")), tasks, "cluster_id", "field", "g")
    winner = F.struct(*win_order(), "v_key", "priority", "completeness", "base", "source", "method", "raw", "malformed", "v_str", "v_num", "v_loc", "v_link", "v_edu")
    won = v.groupBy("cluster_id", "field", "g").agg(F.min(winner).alias("w"), F.min("at").alias("first"))
    w = F.col("w")
    itself = lambda x: (F.col(x)["record_ord"] == w["o4"]) & (F.col(x)["pos"] == w["o5"])
    others = F.when(itself("at") & itself("last"), F.lit(0)).when(itself("at"), F.col("n") - 1).otherwise(F.col("n"))
    same = F.col("v_key") == w["v_key"]
    rows = v.join(won, ["cluster_id", "field", "g"])
    return rows.withColumns({"agree": F.when(same, others).otherwise(F.lit(0)), "differ": F.when(same, F.lit(0)).otherwise(F.col("n")), "reason": lost_reason()})


def lost_reason() -> Column:
    w = F.col("w")
    return F.when(F.col("priority") < w["priority"], "lower_source_priority").when((F.col("priority") == w["priority"]) & (F.col("completeness") < w["completeness"]), "less_complete").otherwise("tiebreak_lost")


def tracked(values: DataFrame, clusters: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per value kept: cluster_id, field, first place, record_ord of the winner, value (in v_*), confidence, primary, agreements, conflicts.

    An agreement or conflict stands once for its n equal rows. The values are dealt to so many tasks, if told.
    """
    w = F.col("w")
    origin = (F.col("source"), F.col("method"), F.coalesce("raw", F.lit("")).alias("raw"), F.col("malformed"))
    agreed = F.struct(*origin, F.col("agree").cast("int").alias("n"))
    lost = F.struct(F.struct(*origin).alias("source"), F.col("tiebreak").alias("shown"), F.col("reason"), F.struct("v_str", "v_num", "v_loc").alias("value"), F.col("differ").cast("int").alias("n"))
    out = compared(values, clusters, tasks).groupBy("cluster_id", "field", "g").agg(
        F.first("w").alias("w"),  # the same in every row of the group
        F.first("first").alias("first"),
        F.max(F.col("agree") > 0).alias("agreed"),
        F.max(F.col("differ") > 0).alias("contested"),
        F.array_sort(F.collect_list(F.when(F.col("agree") > 0, agreed))).alias("agreements"),
        F.array_sort(F.collect_list(F.when(F.col("differ") > 0, lost))).alias("conflicts"),
    )
    penalty = F.when(F.col("field") == "skills", dec(SKILL_MALFORMED_PENALTY)).otherwise(dec(MALFORMED_PENALTY))
    return out.select(
        "cluster_id", "field", "first", w["o4"].alias("record_ord"),
        *(w[c].alias(c) for c in ("v_str", "v_num", "v_loc", "v_link", "v_edu")),
        confidence(w["base"], F.col("agreed"), F.col("contested"), w["malformed"], penalty).alias("confidence"),
        F.struct(w["source"].alias("source"), w["method"].alias("method"), w["raw"].alias("raw"), w["malformed"].alias("malformed")).alias("primary"),
        "agreements", "conflicts",
    )


def _value(field: str) -> Column:
    if field == "years_experience":
        return F.struct(F.col("v_num").alias("num"), F.col("v_str").alias("text"))
    return F.col(VALUE_OF[field])


def _sort_keys(field: str) -> list[Column]:
    blank = lambda c: F.coalesce(c, F.lit(""))
    if field == "skills":
        return [F.lower("v_str")]
    if field == "links":
        return [F.col("v_link")["kind"], F.col("v_link")["url"]]
    if field == "education":
        return [blank(F.col("v_edu")[k]) for k in ("institution", "degree", "start")]
    return [F.col("v_str")]


def record_confidence() -> Column:
    """Mean confidence of all values of a wide row less the completeness penalty, 0 without values; sums are decimals and so exact."""
    each = F.concat(F.array_compact(F.array(*(F.col(f)["confidence"] for f in SCALARS))), *(F.transform(f, lambda tv: tv["confidence"]) for f in COLLECTIONS))
    total = F.aggregate(each, F.lit(0).cast("decimal(20,4)"), lambda a, c: (a + c.cast("decimal(6,4)")).cast("decimal(20,4)"))
    return F.when(F.size(each) == 0, F.lit(0.0)).otherwise(clamp(total.cast("double") / F.size(each) - F.col("completeness_penalty")))


def canonical(values_tracked: DataFrame, clusters: DataFrame, config: FusionConfig = FusionConfig(), tasks: int | None = None) -> DataFrame:
    """One wide row per cluster; clusters without any value are there too."""
    t = dealt(values_tracked, tasks, "cluster_id")
    parts: list[Column] = []
    conflict = lambda f: F.transform("conflicts", lambda c: F.struct((F.struct(c["value"]["v_num"].alias("num"), c["value"]["v_str"].alias("text")) if f == "years_experience" else c["value"][VALUE_OF[f]]).alias("value"), c["source"].alias("source"), c["reason"].alias("reason"), c["n"].alias("n")))
    for f in SCALARS:
        tv = F.struct(_value(f).alias("value"), "confidence", "primary", "agreements", conflict(f).alias("conflicts"))
        parts.append(F.max_by(F.when(F.col("field") == f, tv), F.col("field") == f).alias(f))
    for f in COLLECTIONS:
        tv = F.struct(_value(f).alias("value"), "confidence", "primary", "agreements", F.array().cast(f"array<struct<value: string, source: struct<source: string>, reason: string, n: int>>").alias("conflicts"))
        keys = [k.alias(f"k{i}") for i, k in enumerate(_sort_keys(f))]
        parts.append(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct(*keys, F.col("first").alias("at"), F.hash("first").alias("h"), tv.alias("tv"))))), lambda s: s["tv"]).alias(f))
    wide = t.groupBy("cluster_id").agg(*parts)
    all_ = dealt(clusters.select("cluster_id").distinct(), tasks, "cluster_id").join(wide, "cluster_id", "left")
    for f in COLLECTIONS:
        all_ = all_.withColumn(f, F.coalesce(f, F.array().cast(wide.schema[f].dataType)))
    missing = F.lit(0)
    for f in config.required:
        if f in COLLECTIONS:
            missing = missing + (F.size(f) == 0).cast("int")
        elif f in SCALARS:
            missing = missing + F.col(f).isNull().cast("int")
    penalty = (missing * dec(COMPLETENESS_PENALTY)).cast("double")
    first = lambda f: F.get(f, F.lit(0))["value"]
    row = all_.select(
        "cluster_id",
        candidate_id(first("emails"), first("phones"), F.col("full_name")["value"], F.col("location")["value"]["country"]).alias("candidate_id"),
        *SCALARS,
        *COLLECTIONS,
        penalty.alias("completeness_penalty"),
    )
    return row.withColumn("record_confidence", record_confidence())


def conflicts() -> Column:
    """Conflicts of a canonical row's scalar fields."""
    return sum((F.coalesce(F.aggregate(F.col(f)["conflicts"], F.lit(0).cast("long"), lambda a, c: a + c["n"]), F.lit(0)) for f in SCALARS), F.lit(0))


def conflict_count(canon: DataFrame) -> int:
    return canon.agg(F.sum(conflicts())).first()[0] or 0
