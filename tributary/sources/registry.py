"""Registry of source readers: a reader turns a path (a file, a folder or a glob) into RAW_VALUES rows, lazily.

record_ord keeps the order of sources, of a source's files by path, and of the records in a file: it is the number of
bytes in earlier files plus the record's place, which is smaller than its own file's size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import RAW_VALUES
from ..plans.storage import written

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


@dataclass(frozen=True)
class Source:
    type: str
    path: str


def register(*names: str) -> Callable[[Reader], Reader]:
    def add(reader: Reader) -> Reader:
        for n in names:
            _READERS[n] = reader
        return reader

    return add


def reader(name: str) -> Reader:
    try:
        return _READERS[name]
    except KeyError:
        raise ValueError(f"unknown source type {name!r}; known: {', '.join(known_sources())}") from None


def known_sources() -> list[str]:
    return sorted(_READERS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(RAW_VALUES))


#: Bits of a record's place in its source (a petabyte), and how many sources that leaves room for.
SOURCE_BITS = 50
MAX_SOURCES = 1 << (63 - SOURCE_BITS)
#: Up to so many files, some hundred bytes each, are broadcast with their places.
BROADCAST_FILES = 20_000

#: The file that a row of a file scan comes from.
FILE = "_metadata.file_path"


def files_of(scan: DataFrame) -> list[tuple[str, int]]:
    """Path, and bytes in earlier files, of the scan's files in the order of paths."""
    spark, at, out = scan.sparkSession, 0, []
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for f in sorted(scan.inputFiles()):
        p = path_of(path_of(spark._jvm.java.net.URI(f)).toString())
        out.append((p.toUri().toString(), at))  # as the scan shows it
        at += max(1, p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen())
    return out


def in_order(rows: DataFrame, files: list[tuple[str, int]]) -> DataFrame:
    """rows (file, at: the place in the file) with record_ord."""
    if len(files) <= 1:
        return rows.withColumn("record_ord", F.col("at").cast("long"))
    starts = rows.sparkSession.createDataFrame(files, "file string, start long")
    starts = F.broadcast(starts) if len(files) <= BROADCAST_FILES else starts
    return rows.join(starts, "file").withColumn("record_ord", F.col("start") + F.col("at")).drop("start")


def read_sources(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All sources in list order, written to the shared folder one by one: a source that cannot be read to its end gives no rows."""
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; give folders or globs")
    out = empty(spark)
    for k, s in enumerate(sources):
        try:
            rows = written(reader(s.type)(spark, s.path), f"source-{k}")
        except Exception:  # noqa: BLE001  the contract: any failure of a source means no records from it
            continue
        out = out.unionByName(rows.withColumn("record_ord", F.col("record_ord") + F.lit(k << SOURCE_BITS)))
    return out


def values(records: DataFrame, source: str, columns: list, filled: bool = False) -> DataFrame:
    """RAW_VALUES rows of records (with record_ord) from an array of value structs, plus a marker row for every record (filled: that has a value)."""
    null = lambda t: F.lit(None).cast(t)
    marker = value(None, null("string"), null("string"))
    schema = T._parse_datatype_string(RAW_VALUES)
    each = F.flatten(F.array(*columns))
    if filled:  # within the row: the values are computed once, and no record has to meet itself again
        each = records.select("record_ord", each.alias("each"))
        rows = each.select("record_ord", F.explode(F.when(F.size("each") > 0, F.concat(F.array(marker), "each"))).alias("v"))
    else:
        rows = records.select("record_ord", F.explode(F.concat(F.array(marker), each)).alias("v"))
    rows = rows.select("record_ord", F.lit(source).alias("source"), "v.*")
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def value(field: str | None, raw, method, pos=None, edu=None, malformed=False):
    from ..model import EDUCATION

    return F.struct(
        F.lit(field).cast("string").alias("field"),
        (F.lit(0) if pos is None else pos).cast("int").alias("pos"),
        raw.cast("string").alias("raw"),
        (F.lit(None) if edu is None else edu).cast(EDUCATION).alias("edu"),
        (F.lit(method) if isinstance(method, str) else method).cast("string").alias("method"),
        F.lit(malformed).alias("malformed"),
    )


def one(field: str, raw, method) -> F.Column:
    """An array with the value, or without any if it is blank."""
    return F.filter(F.array(value(field, raw, method)), lambda v: v["raw"].isNotNull() & (v["raw"] != ""))


def many(field: str, raws, method) -> F.Column:
    return F.transform(F.coalesce(raws, F.array().cast("array<string>")), lambda r, i: value(field, r, method, i))
