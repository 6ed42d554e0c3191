"""Delimited files with known header aliases; other columns are not read."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import none_if_blank, strip
from . import splits
from .registry import BROADCAST_FILES, FILE, empty, files_of, in_order, many, one, register, values

# Header aliases.
HEADERS = {
    "name": "full_name", "fullname": "full_name", "full_name": "full_name", "candidate": "full_name", "candidate_name": "full_name",
    "email": "emails", "emails": "emails", "email_address": "emails",
    "phone": "phones", "phones": "phones", "mobile": "phones", "contact": "phones",
    "location": "location", "city": "location", "country": "location",
    "headline": "headline", "title": "headline", "summary": "headline",
    "years_experience": "years_experience", "experience": "years_experience", "yoe": "years_experience", "years": "years_experience",
    "skills": "skills", "skillset": "skills",
    "github": "links", "linkedin": "links", "portfolio": "links", "website": "links",
}
MULTI = ("emails", "phones", "skills")
METHOD = "csv_column"


OPTIONS = {"header": False, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "inferSchema": False}


def _first_lines(spark: SparkSession, lines: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
    """Each file with the cells of its first line; a row a file comes to the driver, as the list of files does."""
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "n").alias("line")).orderBy("file").collect()
    return [(r["file"], tuple(next(csv.reader([r["line"].lstrip("\ufeff")]), ()))) for r in first]


@register("csv")
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every file's first line is its own header. All files are read in splits, those with line breaks inside quotes by `splits`."""
    lines = spark.read.text(path).select("value", F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    files = files_of(lines)
    odd = F.length("value") - F.length(F.replace("value", F.lit('"')))
    whole = not lines.filter(odd % 2 == 1).isEmpty()
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, header in _first_lines(spark, lines):
        by_header.setdefault(header, []).append(file)
    out = empty(spark)
    for header, of in sorted(by_header.items()):
        out = out.unionByName(_of_header(spark, header, of, files, whole))
    return out


def _of_header(spark: SparkSession, header: tuple[str, ...], of: list[str], files: list[tuple[str, int]], whole: bool) -> DataFrame:
    """The records of the files with one header."""
    by_header = {h: f"c{i}" for i, h in enumerate(header)}  # of equal headers the last one counts
    fields: dict[str, list[str]] = {}
    for name, c in by_header.items():
        known = HEADERS.get(re.sub(r"[\s\-]+", "_", name.strip().lower()))
        if known:
            fields.setdefault(known, []).append(c)
    if not fields:
        return empty(spark)
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)).toString() for f in of]
    if whole:  # line breaks inside quotes
        rows, _ = splits.records(splits.chunks(spark, paths, splits.CsvScan()), splits.CsvScan())
        rows = rows.select("file", "at", F.from_csv("text", schema, {k: str(v) for k, v in OPTIONS.items() if k in ("quote", "escape", "mode")}).alias("r")).select("file", "at", "r.*")
    else:
        rows = spark.read.options(**OPTIONS).schema(schema).csv(paths)
        rows = rows.select("*", F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
        # a split's rows are numbered from its first one; a split has fewer rows than bytes
        split = rows.groupBy("file", "block").agg(F.min("n").alias("first"))
        rows = rows.join(F.broadcast(split) if len(of) <= BROADCAST_FILES else split, ["file", "block"]).withColumn("at", F.col("block") + F.col("n") - F.col("first"))
    rows = in_order(rows.filter("at > 0"), files)
    columns, any_cell = [], F.lit(False)
    for field, cs in fields.items():
        cells = [none_if_blank(F.col(c)) for c in cs]
        for cell in cells:
            any_cell = any_cell | cell.isNotNull()
        if field in MULTI:
            parts = [F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda s_: strip(s_)), lambda p: p != "") for c in cells]
            columns.append(many(field, F.flatten(F.array(*parts)), METHOD))
        elif field == "links":
            columns.append(many(field, F.array_compact(F.array(*cells)), METHOD))
        else:  # the last filled cell counts
            columns.append(one(field, F.coalesce(*reversed(cells)), METHOD))
    return values(rows.filter(any_cell), "CSV", columns)
