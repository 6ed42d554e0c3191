"""Runs kept in a folder that outlives the driver.

    <folder>/<run id>/candidates, <folder>/<run id>/reports     Parquet
    <folder>/<time>-<run id>.json                               the manifest: times and counts

A run exists once its manifest does, which is written beside its final name and renamed there last: a crash before leaves
files that no one sees, and `sweep` deletes them. Manifests sort by the time of their commit, so the oldest are known from
names alone. Any session that opens the folder can project its runs.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..model import ProjectionConfig
from ..operators import project
from .storage import delete, shared_dir


class RunStore:
    """The last `capacity` runs of a folder; where none is named, of one of its own in the shared folder."""

    def __init__(self, capacity: int = 50, folder: str | None = None, spark: SparkSession | None = None):
        self.capacity, self.folder = capacity, folder and folder.rstrip("/")
        self.spark = spark

    def _open(self, spark: SparkSession | None = None) -> SparkSession:
        self.spark = spark or self.spark or SparkSession.getActiveSession()
        if self.spark is None:
            raise RuntimeError("no Spark session")
        if self.folder is None:
            self.folder = f"{shared_dir(self.spark)}/tributary/runs-{uuid.uuid4().hex}"
        return self.spark

    def _path(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        p, fs = self._path()
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _manifests(self) -> dict[str, str]:
        """The manifest of each run, the oldest first."""
        self._open()
        return {n[:-5].split("-", 1)[1]: n for n in self._names() if n.endswith(".json")}

    def run_ids(self) -> list[str]:
        return list(self._manifests())

    def put(self, result) -> str:
        """Writes a result and commits it; gives its id."""
        self._open(result.candidates.sparkSession)
        run_id = uuid.uuid4().hex[:12]
        result.candidates.write.parquet(f"{self.folder}/{run_id}/candidates")
        result.reports.write.parquet(f"{self.folder}/{run_id}/reports")
        self._commit(run_id, asdict(result.stats))
        for old, manifest in list(self._manifests().items())[: -self.capacity]:
            delete(self.spark, f"{self.folder}/{manifest}")  # first, so that no manifest names files that have gone
            delete(self.spark, f"{self.folder}/{old}")
        return run_id

    def _commit(self, run_id: str, stats: dict) -> None:
        name = f"{time.time_ns():020d}-{run_id}.json"
        draft, fs = self._path(f"{name}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(stats).encode()))
        out.close()
        if not fs.rename(draft, self._path(name)[0]):
            raise OSError(f"run {run_id} could not be committed")

    def _of(self, run_id: str) -> str:
        manifests = self._manifests()
        if run_id not in manifests:
            raise KeyError(f"unknown run_id {run_id!r}")
        return manifests[run_id]

    def __contains__(self, run_id: str) -> bool:
        return run_id in self._manifests()

    def candidates(self, run_id: str) -> DataFrame:
        self._of(run_id)
        return self.spark.read.parquet(f"{self.folder}/{run_id}/candidates")

    def reports(self, run_id: str) -> DataFrame:
        self._of(run_id)
        return self.spark.read.parquet(f"{self.folder}/{run_id}/reports")

    def stats(self, run_id: str) -> dict:
        """timings_ms, records_in, clusters_out and conflicts_found of the run."""
        p, fs = self._path(self._of(run_id))
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def project(self, run_id: str, config: ProjectionConfig) -> DataFrame:
        return project.project(self.candidates(run_id), config)

    def sweep(self) -> None:
        """Deletes what no manifest names. Not while another session puts a run."""
        runs = self._manifests()
        for name in self._names():
            if name not in runs and name not in runs.values():
                delete(self.spark, f"{self.folder}/{name}")
