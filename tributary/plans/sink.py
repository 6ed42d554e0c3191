"""Results written by tasks, in order, as JSON arrays in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ProjectionConfig
from ..operators.project import project, serialize


def write_array(items: DataFrame, path: str, text: str, order: str = "cluster_id") -> None:
    """Writes the JSON texts of a column, an item a line, to files that, one after another by name, are one JSON array.

    Files are ranges of `order`, which no two rows share and which is never null. The least and the greatest tell which
    items open and close the array, so no task knows of another. Without rows it is the array without items.
    """
    ends = items.agg(F.min(order).alias("first"), F.max(order).alias("last")).first()
    if ends["first"] is None:
        items.sparkSession.range(1).select(F.lit("[]").alias("value")).coalesce(1).write.text(path)
        return
    opening = F.when(F.col(order) == F.lit(ends["first"]), "[").otherwise("")
    closing = F.when(F.col(order) == F.lit(ends["last"]), "]").otherwise(",")
    items.orderBy(order).select(F.concat(opening, F.col(text), closing).alias("value")).write.text(path)


def write_run(result, folder: str, projection: ProjectionConfig | None = None) -> None:
    """<folder>/candidates, whole or as projected, and <folder>/reports: JSON arrays in the order of clusters."""
    folder = folder.rstrip("/")
    if projection:
        write_array(project(result.candidates, projection), f"{folder}/candidates", "output")
    else:
        write_array(serialize(result.candidates), f"{folder}/candidates", "candidate")
    report = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    write_array(result.reports.select("cluster_id", report.alias("report")), f"{folder}/reports", "report")
