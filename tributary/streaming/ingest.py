"""Records that keep arriving: read and normalized as a stream, which is stateless; or read and resolved batch by batch, with a `ClusterState`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import none_if_blank
from ..model import FusionConfig
from ..operators.normalize import normalize
from ..sources.json_profiles import _clean, _get, _place, _texts
from ..sources.registry import many, one, values
from .clusters import ClusterState


def ats_lines(spark: SparkSession, folder: str) -> DataFrame:
    """RAW_VALUES of files with one JSON candidate a line, as they arrive; record_ord is a hash of the line."""
    o, m = F.col("obj"), "ats_json"
    rows = spark.readStream.text(folder).select(F.xxhash64("value").alias("record_ord"), F.col("value").alias("obj"))
    rows = rows.filter(F.json_object_keys("obj").isNotNull())
    return values(rows, "ATS", [
        one("full_name", _clean(o, "fullName", "name"), m),
        one("headline", _clean(o, "currentTitle", "title", "headline"), m),
        one("emails", _clean(o, "email"), m),
        one("phones", _clean(o, "phone"), m),
        one("location", _place(_get(o, "location")), m),
        one("years_experience", none_if_blank(_get(o, "yearsExperience")), m),
        many("skills", _texts(_get(o, "skills")), m),
        many("links", _texts(_get(o, "links")), m),
    ])


def start(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], config: FusionConfig = FusionConfig(), once: bool = True) -> StreamingQuery:
    """Normalizes what arrives in the folder and hands each micro-batch to the sink, for example to append it to the table of values."""
    return _run(normalize(ats_lines(spark, folder), config), checkpoint, sink, once)


def resolve_stream(spark: SparkSession, folder: str, checkpoint: str, state: ClusterState, once: bool = True) -> StreamingQuery:
    """Takes what arrives in the folder up into the state. A micro-batch that is run again after a failure changes nothing more."""
    return _run(ats_lines(spark, folder), checkpoint, lambda batch, number: state.update(batch, number), once)


def _run(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
