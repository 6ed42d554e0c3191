"""Resolution of records that keep arriving: after every batch the clusters are those of one run over all records so far.

    <folder>/<batch>-delta/{keys, names, records}     what a batch added and changed
    <folder>/<batch>-full/{keys, names, records}      the whole state, every `full_every` batches

`keys` (key, its first record seen) and `names` (record, surname, name) only grow; `records` (record, guard bits, root,
cluster) is a log, of which each record's row of the latest batch counts. Records are written last, and their _SUCCESS
commits the batch; a batch that is run again reads the batches before it and writes the same.

A batch joins the log with what it reaches only: the roots that share a key with it, and the roots whose records have the
surnames of those, and so on where one root has several surnames. Greedy links depend on the order of a surname's records,
so these surnames are linked anew, and nothing else is.

Defined cases: a record that the state has already is left out, whatever it says now; an empty batch is committed and
changes nothing; records without values are clusters of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FusionConfig
from ..operators import resolve
from ..operators.components import components
from ..operators.normalize import normalize
from ..plans.storage import delete, scratch, written

TABLES = {
    "keys": "key STRING, record_ord BIGINT",
    "names": "record_ord BIGINT, surname STRING, name STRING",
    "records": "record_ord BIGINT, guard INT, root BIGINT, cluster_id BIGINT, batch BIGINT",
}


def _latest(log: DataFrame) -> DataFrame:
    newest = log.groupBy("record_ord").agg(F.max_by(F.struct("guard", "root", "cluster_id"), "batch").alias("r"))
    return newest.select("record_ord", "r.guard", "r.root", "r.cluster_id")


def _of_records(log: DataFrame, ids: DataFrame) -> DataFrame:
    return _latest(log.join(ids.select("record_ord").distinct(), "record_ord", "left_semi"))


def _of_roots(log: DataFrame, roots: DataFrame) -> DataFrame:
    """The records that have one of the roots now: of those that ever had one."""
    roots = roots.select("root").distinct()
    return _of_records(log, log.join(roots, "root", "left_semi")).join(roots, "root", "left_semi")


class ClusterState:
    """Clusters of all records so far, in a folder that any session can open."""

    def __init__(self, folder: str, config: FusionConfig = FusionConfig(), full_every: int = 16):
        self.folder, self.config, self.full_every = folder.rstrip("/"), config, full_every

    def _batches(self, spark: SparkSession, before: int | None = None) -> list[tuple[int, str]]:
        """Committed batches from the last full one on, in order: number and folder."""
        top = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []
        done = [(int(n.split("-")[0]), n) for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/records/_SUCCESS"))]
        done = [b for b in done if before is None or b[0] < before]
        full = [i for i, b in enumerate(done) if b[1].endswith("-full")]
        return done[full[-1] :] if full else done

    def _read(self, spark: SparkSession, batches: list[tuple[int, str]], name: str) -> DataFrame:
        if not batches:
            return spark.createDataFrame([], TABLES[name])
        return spark.read.schema(TABLES[name]).parquet(*(f"{self.folder}/{b}/{name}" for _, b in batches))

    def clusters(self, spark: SparkSession) -> DataFrame:
        """record_ord and cluster_id of all records."""
        return _latest(self._read(spark, self._batches(spark), "records")).select("record_ord", "cluster_id")

    def update(self, raw: DataFrame, batch: int) -> DataFrame:
        """Takes up a batch of RAW_VALUES rows; gives record_ord and cluster_id of the records that are new or whose cluster or root is another now."""
        spark = raw.sparkSession
        before = self._batches(spark, batch)
        keys, names, log = (self._read(spark, before, t) for t in TABLES)
        with scratch(spark):
            raw = written(raw, "arrived")
            ids = raw.select("record_ord").distinct()
            new = written(ids.join(_of_records(log, ids), "record_ord", "left_anti"), "new-records")
            values = normalize(raw.join(new, "record_ord", "left_semi"), self.config, fields=("full_name", "emails", "phones", "links"))
            values = written(values, "new-values")
            new_keys = written(resolve.exact_keys(values), "new-keys")
            new_names = written(resolve.first_names(values), "new-names")
            all_names = names.unionByName(new_names)

            # exact keys: the batch's records among themselves, and with the roots that hold a key
            seen = written(keys.join(new_keys.select("key").distinct(), "key", "left_semi").select("key", F.col("record_ord").alias("holder")), "seen-keys")
            roots = _of_records(log, seen.select(F.col("holder").alias("record_ord"))).select(F.col("record_ord").alias("holder"), "root")
            old = written(new_keys.join(seen, "key").join(roots, "holder").select(F.col("root").alias("a"), F.col("record_ord").alias("b")).distinct(), "key-edges")
            tied = written(components(resolve.key_edges(new_keys).unionByName(old)), "tied")
            renamed = tied.toDF("root", "now")
            reached = _of_roots(log, old.select(F.col("a").alias("root")))
            arrived = new.join(resolve.guards(values), "record_ord", "left").join(tied.toDF("record_ord", "now"), "record_ord", "left")
            arrived = written(arrived.select("record_ord", F.coalesce("guard", F.lit(0)).alias("guard"), F.coalesce("now", "record_ord").alias("now")), "arrived-records")

            # surnames of these, and of the roots that have them, until no more come
            touched = written(arrived.select("record_ord").union(reached.select("record_ord")), "touched")
            surnames, n = None, -1
            while True:
                found = written(all_names.join(touched, "record_ord", "left_semi").select("surname").distinct(), "surnames")
                if (m := found.count()) == n:
                    break
                surnames, n = found, m
                inside = _of_records(log, names.join(surnames, "surname", "left_semi"))
                stored = _of_roots(log, inside.unionByName(reached.select(*inside.columns)))
                stored = written(stored.select("record_ord", "guard", "root", "cluster_id"), "stored")
                touched = stored.select("record_ord").union(arrived.select("record_ord"))

            known = stored.join(renamed, "root", "left").select("record_ord", "guard", F.coalesce("now", "root").alias("now"), "root", "cluster_id")
            both = known.unionByName(arrived, allowMissingColumns=True).withColumnsRenamed({"root": "old_root", "cluster_id": "old_cluster", "now": "root"})
            both = written(both, "reached-records")
            linked = resolve.linked_names(written(resolve.units(all_names, both), "units"), self.config.fuzzy_threshold)
            after = both.join(linked, "root", "left").withColumn("cluster_id", F.coalesce("cluster_id", "root"))
            other = ~F.col("root").eqNullSafe(F.col("old_root")) | ~F.col("cluster_id").eqNullSafe(F.col("old_cluster"))
            changed = written(after.filter(other).select("record_ord", "guard", "root", "cluster_id", F.lit(batch).cast("long").alias("batch")), "changed")

            added = new_keys.groupBy("key").agg(F.min("record_ord").alias("record_ord")).join(seen, "key", "left_anti")
            full = len(before) >= self.full_every
            into = f"{self.folder}/{batch:020d}-{'full' if full else 'delta'}"
            records = _latest(log.unionByName(changed)).withColumn("batch", F.lit(batch).cast("long")) if full else changed
            (keys.unionByName(added) if full else added).write.mode("overwrite").parquet(f"{into}/keys")
            (all_names if full else new_names).write.mode("overwrite").parquet(f"{into}/names")
            records.write.mode("overwrite").parquet(f"{into}/records")
        self._forget(spark, before)
        done = spark.read.schema(TABLES["records"]).parquet(f"{into}/records")
        return done.filter(F.col("batch") == batch).select("record_ord", "cluster_id") if not full else done.select("record_ord", "cluster_id")

    def _forget(self, spark: SparkSession, before: list[tuple[int, str]]) -> None:
        """Deletes what precedes the full batch that this one has read: no batch as old will be run again."""
        if before and before[0][1].endswith("-full"):
            top = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            for s in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top):
                name = s.getPath().getName()
                if name[:1].isdigit() and int(name.split("-")[0]) < before[0][0]:
                    delete(spark, f"{self.folder}/{name}")
