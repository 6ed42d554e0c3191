"""Sources of one's own that Spark reads in parallel, by the Python DataSource API.

    class Directory(RecordSource):
        source, method = "CSV", "directory"

        @classmethod
        def name(cls): return "directory"

        def slices(self): return [self.options["path"] + f"/{k}" for k in range(8)]

        def records(self, part): yield {"full_name": "Jane Doe", "emails": ["j@x.org"]}

    register_source(spark, Directory)
    read_sources(spark, [Source("directory", "ldap://host")])     # as any source type
    spark.read.format("directory").load("ldap://host")            # RAW_VALUES rows

Every slice is a partition of the scan. record_ord keeps the order of slices and of the records in each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import COLLECTIONS, RAW_VALUES, SCALARS
from .registry import SOURCE_BITS, register

#: Bits of a record's number in its slice; the rest of SOURCE_BITS is the slice's.
RECORD_BITS = 32
FIELDS = (*SCALARS, *COLLECTIONS)


class RecordSource(DataSource):
    """Records as dicts from field to value or list of values, slice by slice. Subclasses give name(), slices() and records()."""

    #: The source that the values are from, by which they are ranked, and the method that provenance names.
    source, method = "CSV", "source"

    def schema(self) -> str:
        return RAW_VALUES

    def slices(self) -> list[Any]:
        """What the partitions read, each anything that can be pickled. Runs on the driver."""
        raise NotImplementedError

    def records(self, part: Any) -> Iterator[dict[str, Any]]:
        """The records of a slice, on an executor."""
        raise NotImplementedError

    def reader(self, schema: Any) -> DataSourceReader:
        return _SliceReader(self)


class _Slice(InputPartition):
    def __init__(self, number: int, part: Any):
        super().__init__((number, part))


class _SliceReader(DataSourceReader):
    def __init__(self, of: RecordSource):
        self.of = of

    def partitions(self) -> list[InputPartition]:
        found = [_Slice(k, part) for k, part in enumerate(self.of.slices())]
        if len(found) > 1 << (SOURCE_BITS - RECORD_BITS):
            raise ValueError(f"more than {1 << (SOURCE_BITS - RECORD_BITS)} slices")
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, part = partition.value
        for k, record in enumerate(self.of.records(part)):
            at = (number << RECORD_BITS) + k
            yield at, self.of.source, None, 0, None, None, None, False
            unknown = set(record) - set(FIELDS)
            if unknown:
                raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
            for field, given in record.items():
                for pos, value in enumerate(given if isinstance(given, (list, tuple)) else [given]):
                    if value is None or not str(value).strip():
                        continue
                    if field == "education":
                        edu = tuple(value.get(c) for c in ("institution", "degree", "field_of_study", "start", "end"))
                        yield at, self.of.source, field, pos, None, edu, self.of.method, False
                    else:
                        yield at, self.of.source, field, pos, str(value), None, self.of.method, False


def register_source(spark: SparkSession, source: type[RecordSource], *names: str) -> None:
    """Makes a source known to the session by its name, and to `read_sources` by it and the other names."""
    spark.dataSource.register(source)

    def read(session: SparkSession, path: str) -> DataFrame:
        return session.read.format(source.name()).load(path)

    register(source.name(), *names)(read)
