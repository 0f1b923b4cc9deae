"""The learning store: observations by day, mergeable counts by day, patterns by bucket, in Parquet.

Every write is a dynamic partition overwrite: of the days and the batch that a batch of observations
touches, of the counts of these days, and of the buckets whose patterns have changed. Other partitions
keep their files, so what is written grows with the change and not with the store; a batch or a
consolidation that is repeated after a failure writes the same partitions again.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import learning
from siftline.schemas import PATTERNS
from siftline.session import checkpoint_dir

#: Parts of the pattern table.
BUCKETS = 64


class LearningStore:
    def __init__(self, spark: SparkSession, root: str, order: str = "seq", buckets: int = BUCKETS) -> None:
        """``order`` is the column of the observations that says which was seen first."""
        self.spark, self.root, self.order, self.buckets = spark, root.rstrip("/"), order, buckets

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(table))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # not there, or nothing left
                return None
            raise

    def _overwrite(self, df: DataFrame, table: str, *parts: str) -> None:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*parts).parquet(self._path(table))

    def _remove(self, table: str, part: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(table)}/{part}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _kept(self, df: DataFrame) -> DataFrame:
        """The rows as a work table, computed once; the store's next one takes its place, so one is left at most."""
        store = hashlib.sha256(self.root.encode()).hexdigest()[:16]
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/upserted-{store}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last_epoch(self) -> int:
        """The last stream batch that is consolidated."""
        done = self._read("epochs")
        return -1 if done is None else done.agg(F.max("epoch")).first()[0]

    def observations(self) -> DataFrame | None:
        log = self._read("observations")
        return None if log is None else log.drop("day", "batch")

    def patterns(self) -> DataFrame:
        stored = self._read("patterns")
        if stored is None:
            return self.spark.createDataFrame([], PATTERNS)
        return learning.as_patterns(stored)

    def log_patterns(self) -> DataFrame | None:
        """The patterns of the log as it is now, from the counts by day."""
        counts = self._read("counts")
        return None if counts is None else learning.finished(learning.merged(counts))

    def record(self, obs: DataFrame, batch: str | None = None) -> None:
        """Append observations to the log; writing a named batch again replaces it.

        The counts of the batch's days are taken from the log again; other days stay as they are.
        """
        name = batch or f"one-{uuid.uuid4().hex}"
        dated = obs.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("batch", F.lit(name))
        self._overwrite(dated, "observations", "day", "batch")
        written = self._read("observations")
        if written is not None:
            # One name for each day.
            days = written.filter(F.col("batch") == name).select("day").distinct().collect()
            self._count([str(r["day"]) for r in days])

    def _count(self, days: list[str]) -> None:
        if days:
            log = self._read("observations").filter(F.col("day").isin(days))
            self._overwrite(learning.partials(log, self.order, ("day",)), "counts", "day")

    def consolidate(self, now: str, epoch: int = -1) -> dict[str, int]:
        """Upsert the patterns of the log, then prune it; returns the counts.

        Repeating it after a failure gives the same patterns. One writer at a time.
        """
        log, fresh = self.observations(), self.log_patterns()
        if log is None or fresh is None:
            return {}
        stored = self.patterns()
        bucket = F.pmod(F.xxhash64("pattern_key"), F.lit(self.buckets)).cast("int")
        upserted = self._kept(learning.upsert_fresh(stored, fresh))
        # One number for each bucket.
        changed = upserted.filter("changed").select(bucket.alias("bucket")).distinct().collect()
        counts = learning.consolidation_summary(upserted, log, now).first().asDict()
        if changed:
            mine = learning.as_patterns(upserted.filter(bucket.isin([r["bucket"] for r in changed])))
            self._overwrite(mine.withColumn("bucket", bucket).repartition("bucket"), "patterns", "bucket")
        self._prune(dt.datetime.fromisoformat(now) - dt.timedelta(days=learning.RETENTION_DAYS))
        done = self.spark.createDataFrame([(epoch,)], "epoch long")
        done.write.mode("append").parquet(self._path("epochs"))
        return counts

    def _prune(self, limit: dt.datetime) -> None:
        """Take observations up to the limit out of the log: whole parts go, the others of its day are rewritten."""
        log = self._read("observations").filter(F.col("day") <= F.lit(str(limit.date())))
        live = F.col("ts") > F.lit(limit)
        parts = log.groupBy("day", "batch").agg(F.count("*").alias("n"), F.count_if(live).alias("kept")).collect()
        partial = [r for r in parts if 0 < r["kept"] < r["n"]]
        if partial:
            mine = F.struct(F.col("day").cast("string"), "batch").isin(
                *[F.struct(F.lit(str(r["day"])), F.lit(r["batch"])) for r in partial]
            )
            self._overwrite(log.filter(live & mine), "observations", "day", "batch")
        for r in parts:
            if not r["kept"]:
                self._remove("observations", f"day={r['day']}/batch={r['batch']}")
        left = {str(r["day"]) for r in parts if r["kept"]}
        for day in {str(r["day"]) for r in parts} - left:
            self._remove("observations", f"day={day}")
            self._remove("counts", f"day={day}")
        self._count(sorted(left))

    def generate_rules(self, min_count: int = learning.RULE_MIN_COUNT) -> DataFrame:
        """Write the due rules as a table, flag their patterns and return the rules."""
        stored = self._read("patterns")
        path = self._path(f"rules/r-{uuid.uuid4().hex}")
        learning.rules(self.patterns(), min_count).write.parquet(path)
        emitted = self.spark.read.parquet(path)
        if stored is not None:
            # One number for each bucket.
            mine = stored.join(emitted.select("pattern_key"), "pattern_key", "left_semi").select("bucket").distinct()
            touched = [r["bucket"] for r in mine.collect()]
            if touched:
                old = stored.filter(F.col("bucket").isin(touched))
                self._overwrite(learning.flag_generated(old, emitted), "patterns", "bucket")
        return emitted
