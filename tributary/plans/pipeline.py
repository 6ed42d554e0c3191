"""The whole run: read, normalize, resolve, merge, validate, verify."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import FusionConfig, ProjectionConfig
from ..operators import merge, normalize, project, resolve, validate, verify
from ..operators.display import saved_projections
from ..sources import Source, read_sources
from ..sources.json_profiles import login_for_verification
from .runs import RunStore
from .storage import scratch, written


@dataclass
class RunStats:
    timings_ms: dict[str, float] = field(default_factory=dict)
    records_in: int = 0
    clusters_out: int = 0
    conflicts_found: int = 0

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        yield
        self.timings_ms[name] = self.timings_ms.get(name, 0.0) + 1000 * (time.perf_counter() - began)

    @property
    def total_ms(self) -> float:
        return sum(self.timings_ms.values())


@dataclass
class RunResult:
    candidates: DataFrame
    reports: DataFrame
    stats: RunStats


def fuse(raw: DataFrame, config: FusionConfig = FusionConfig(), stats: RunStats | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical rows and the issues of RAW_VALUES rows. Counts are observed while the stages are written; other tables go."""
    stats = stats or RunStats()
    counted, records, people = Observation(), Observation(), Observation()
    one = F.count(F.lit(1)).alias("n")
    with scratch(raw.sparkSession):
        with stats.stage("normalize"):
            values = written(normalize.normalize(raw, config).observe(counted, one), "values")
            tasks = max(1, -(-counted.get["n"] // merge.TASK_VALUES))
        with stats.stage("resolve"):
            clusters = written(resolve.resolve(raw, values, config).observe(records, one), "clusters")
        with stats.stage("merge"):
            canon = merge.canonical(merge.tracked(values, clusters, tasks), clusters, config, tasks)
            canon = written(canon.observe(people, one, F.sum(merge.conflicts()).alias("conflicts")), "canonical", keep=True)
        with stats.stage("validate"):
            found = written(validate.issues(canon), "issues", keep=True)
    stats.records_in, stats.clusters_out, stats.conflicts_found = records.get["n"], people.get["n"], people.get["conflicts"] or 0
    return canon, found


def run(spark: SparkSession, sources: list[Source], config: FusionConfig = FusionConfig(), linkedin_ids: tuple[str, ...] = ()) -> RunResult:
    stats = RunStats()
    with stats.stage("extract"):
        raw = read_sources(spark, sources)
    canon, found = fuse(raw, config, stats)
    with stats.stage("verify"):
        given = [x for x in linkedin_ids if x.strip()][:1]
        canon, a = verify.verify(canon, "linkedin", given, bonus=True)
        logins = [x for x in (login_for_verification(s.path) for s in sources if s.type.startswith("github")) if x]
        canon, b = verify.verify(canon, "github", logins, exclude_source="GitHub")
    extra = a.unionByName(b).withColumn("issue_ord", F.lit(7))
    return RunResult(canon.orderBy("cluster_id"), validate.reports(canon, found.unionByName(extra)), stats)


def run_response(store: RunStore, result: RunResult) -> dict:
    """What a caller is told of a run: its id in the store, candidates and reports in order, times and counts."""
    run_id, s = store.put(result), result.stats
    kept = store.candidates(run_id)
    return {
        "run_id": run_id,
        "candidates": [json.loads(r["candidate"]) for r in project.serialize(kept).orderBy("cluster_id").toLocalIterator()],
        "validation": [r.asDict(recursive=True) for r in result.reports.orderBy("cluster_id").toLocalIterator()],
        "timings_ms": dict(s.timings_ms),
        "stats": {"records_in": s.records_in, "clusters_out": s.clusters_out, "conflicts_found": s.conflicts_found},
    }


def project_response(store: RunStore, run_id: str, projection: dict | None = None, projection_id: str | None = None, folder: str | None = None) -> dict:
    """A stored run's rows by a given projection, or by one saved in the folder. KeyError: unknown run or projection; ValueError: neither is given."""
    if run_id not in store:
        raise KeyError(f"unknown run_id {run_id!r}")
    if projection is not None:
        config = project.from_dict(projection)
    elif projection_id is not None:
        files = saved_projections(folder) if folder else {}
        if projection_id not in files:
            raise KeyError(f"unknown projection {projection_id!r}")
        config = project.load_projection(str(files[projection_id]))
    else:
        raise ValueError("give a projection or a projection_id")
    return {"output": [json.loads(r["output"]) for r in store.project(run_id, config).orderBy("cluster_id").toLocalIterator()]}
