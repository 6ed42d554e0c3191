"""What a page shows of canonical rows: order, tones, short texts."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .project import load_projection, sources


def ranked(canon: DataFrame) -> DataFrame:
    """Most confident first, ties by candidate id."""
    return canon.orderBy(F.desc("record_confidence"), "candidate_id")


def tone(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.75, "mid").otherwise("low")


def place(location: Column) -> Column:
    return F.concat_ws(", ", location["city"], location["region"], location["country"])


def school(item: Column) -> Column:
    span = F.concat_ws(" - ", item["start"], item["end"])
    return F.concat_ws(", ", item["degree"], item["field_of_study"], item["institution"], F.nullif(span, F.lit("")))


def initials(name: Column) -> Column:
    """The first letters of the first and the last word, or ? without a name."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    ends = F.when(F.size(words) > 1, F.array(F.get(words, F.lit(0)), F.element_at(words, -1))).otherwise(words)
    return F.coalesce(F.nullif(F.upper(F.array_join(F.transform(ends, lambda w: F.substring(w, 1, 1)), "")), F.lit("")), F.lit("?"))


def skills_summary(canon: DataFrame) -> DataFrame:
    """cluster_id, mean confidence of the skills (null without any) and all their sources."""
    total = F.aggregate("skills", F.lit(0.0), lambda a, s: a + s["confidence"])
    return canon.select(
        "cluster_id",
        F.when(F.size("skills") > 0, total / F.size("skills")).alias("mean_confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("skills", sources)))).alias("sources"),
    )


def saved_projections(folder: str) -> dict[str, Path]:
    """Files (projection_*.yaml, .yml or .json) of a folder by id."""
    return {p.stem.removeprefix("projection_"): p for p in sorted(Path(folder).glob("projection_*")) if p.suffix in (".yaml", ".yml", ".json")}


def projection_catalog(folder: str) -> list[dict]:
    """Saved projections of a folder: id, name and output fields, sorted by id."""
    configs = {i: load_projection(str(p)) for i, p in saved_projections(folder).items()}
    return [{"id": i, "name": c.name, "fields": [f.out for f in c.fields]} for i, c in sorted(configs.items())]


def json_chunks(texts: Iterable[str], pretty: bool) -> Iterator[str]:
    """A JSON array of rendered objects, piece by piece, their keys sorted."""
    ahead, between = ("\n  ", ",\n  ") if pretty else ("", ", ")
    yield "["
    any_yet = False
    for t in texts:
        item = json.dumps(json.loads(t), sort_keys=True, indent=2 if pretty else None, ensure_ascii=False)
        yield (between if any_yet else ahead) + item.replace("\n", "\n  ")
        any_yet = True
    yield "\n]" if pretty and any_yet else "]"


def to_json(texts: Iterable[str], pretty: bool) -> str:
    return "".join(json_chunks(texts, pretty))
