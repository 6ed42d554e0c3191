"""Runtime projections: a declared list of paths compiled to a select; and JSON renderings of canonical rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COLLECTIONS, SCALARS, FieldMapping, ProjectionConfig

PATH = re.compile(r"^(\w+)(?:\[(\d+)\])?(?:\.(\w+))?$")
ATTRIBUTES = {"location": ("city", "region", "country"), "links": ("kind", "url", "handle"), "education": ("institution", "degree", "field_of_study", "start", "end")}
PLAIN = ("candidate_id", "record_confidence", "completeness_penalty")
MISSING = ("omit", "null", "empty_string")


def load_projection(path: str) -> ProjectionConfig:
    text = open(path, encoding="utf-8").read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return from_dict(yaml.safe_load(text))
    return from_dict(json.loads(text))


def from_dict(d: dict) -> ProjectionConfig:
    missing = d.get("missing_value_policy", "null")
    if missing not in MISSING:
        raise ValueError(f"missing_value_policy must be one of {', '.join(MISSING)}, not {missing!r}")
    fields = tuple(FieldMapping(f["canonical"], f.get("out") or f["canonical"]) if isinstance(f, dict) else FieldMapping(f, f) for f in d.get("fields", []))
    return ProjectionConfig(d.get("name", "default"), fields, bool(d.get("include_confidence")), bool(d.get("include_provenance")), missing)


def sources(tv: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.array(tv["primary"]["source"]), F.transform(tv["agreements"], lambda a: a["source"]))))


def _json(x: Column) -> Column:
    """JSON text of any column: structs lose their null members."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))


def _plain(tv: Column, field: str) -> Column:
    if field == "years_experience":
        return F.coalesce(F.nullif(F.regexp_extract(F.to_json(F.struct(tv["value"]["num"].alias("x"))), r"^\{\"x\":(.*)\}$", 1), F.lit("")), _text(tv["value"]["text"]))
    return F.when(tv["value"].isNull(), F.lit("null")).otherwise(F.nullif(_json(tv["value"]), F.lit("")))


def _text(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def _rounded(x: Column) -> Column:
    return F.regexp_replace(F.bround(x, 4).cast("decimal(10,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def _object(members: list[tuple[str, Column]]) -> Column:
    """A JSON object of rendered members; null members are left out."""
    parts = [F.concat(F.lit(json.dumps(k) + ": "), v) for k, v in members]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def _render(tv: Column, field: str, attribute: str | None, config: ProjectionConfig) -> Column:
    if attribute:
        known = attribute in ATTRIBUTES.get(field, ())
        bare = F.coalesce(_text(tv["value"][attribute]), F.lit("null")) if known else F.lit("null")  # an attribute that isn't there is null, not missing
        bare = F.when(bare == "", F.lit("null")).otherwise(bare)
    else:
        bare = _plain(tv, field)
    if not config.include_confidence and not config.include_provenance:
        return bare
    members = [("value", bare)]
    if config.include_confidence:
        members.append(("confidence", _rounded(tv["confidence"])))
    if config.include_provenance:
        members += [("source", _text(tv["primary"]["source"])), ("method", _text(tv["primary"]["method"])), ("sources", F.to_json(sources(tv)))]
    return _object(members)


def compile_path(path: str, config: ProjectionConfig) -> Column:
    """JSON text of a path in a canonical row, or null if it is missing."""
    m = PATH.match(path)
    if not m:
        return F.lit(None).cast("string")
    name, index, attribute = m.groups()
    if name in PLAIN:
        return _json(F.col(name))
    if name in SCALARS:
        return F.when(F.col(name).isNotNull(), _render(F.col(name), name, attribute, config))
    if name in COLLECTIONS:
        if index is not None:
            tv = F.get(F.col(name), F.lit(int(index)))
            return F.when(tv.isNotNull(), _render(tv, name, attribute, config))
        items = F.transform(F.col(name), lambda tv: _render(tv, name, attribute, config))
        return F.when(F.size(name) > 0, F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
    return F.lit(None).cast("string")


def project(canon: DataFrame, config: ProjectionConfig) -> DataFrame:
    """cluster_id and output, a JSON object of the declared fields; of fields with one name the last counts."""
    last = {m.out: m for m in config.fields}
    absent = {"omit": F.lit(None).cast("string"), "null": F.lit("null"), "empty_string": F.lit('""')}[config.missing]
    members = [(out, F.coalesce(compile_path(m.canonical, config), absent)) for out, m in last.items()]
    return canon.select("cluster_id", _object(members).alias("output"))


def serialize(canon: DataFrame) -> DataFrame:
    """cluster_id and candidate, a JSON object of the whole row with sorted keys; raw inputs are left out."""

    def value_json(tv: Column, f: str) -> Column:
        conflicts = F.flatten(F.transform(tv["conflicts"], lambda c: F.array_repeat(_object([("reason", _text(c["reason"])), ("source", _text(c["source"]["source"])), ("value", _plain(c, f))]), c["n"])))
        return _object([
            ("confidence", _rounded(tv["confidence"])),
            ("conflicts", F.when(F.size(tv["conflicts"]) > 0, F.concat(F.lit("["), F.array_join(conflicts, ", "), F.lit("]")))),
            ("malformed", F.when(tv["primary"]["malformed"], F.lit("true"))),
            ("method", _text(tv["primary"]["method"])),
            ("source", _text(tv["primary"]["source"])),
            ("sources", F.to_json(sources(tv))),
            ("value", _plain(tv, f)),
        ])

    def value_json_of(f: str):
        return lambda tv: value_json(tv, f)

    members = [("candidate_id", _text(F.col("candidate_id"))), ("completeness_penalty", _rounded(F.col("completeness_penalty"))), ("record_confidence", _rounded(F.col("record_confidence")))]
    for f in SCALARS:
        members.append((f, F.coalesce(F.when(F.col(f).isNotNull(), value_json(F.col(f), f)), F.lit("null"))))
    for f in COLLECTIONS:
        members.append((f, F.concat(F.lit("["), F.array_join(F.transform(F.col(f), value_json_of(f)), ", "), F.lit("]"))))
    return canon.select("cluster_id", _object(sorted(members, key=lambda m: m[0])).alias("candidate"))
