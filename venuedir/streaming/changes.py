"""Continuous replay of favourites, notes and logins.

A late remove can bring a later add back to life, so the current favourites alone are
not enough to go on from. The operations that can still matter are: they are few, and
replaying them gives the state (``replay.condensed``). The store keeps these in buckets of keys,
each as a base and the runs that came since. A micro-batch writes its own condensed operations as one
run per bucket and touches nothing else; where the runs of a bucket reach a share of its base, or
are many, they are condensed into a new base. Readers replay base and runs together.

Logins are kept beside: a late one changes what earlier operations of a device mean, so devices are re-keyed to
users when the state is read, out of all logins up to then.

Every file belongs to a batch id, and counts only once the batch's list of versions is written, which comes last. A batch
that is run again after a failure reads lists of earlier batches only and overwrites its own files, so the result is the same.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from venuedir import schema
from venuedir.operators.replay import condensed, replay_favorites, replay_notes
from venuedir.plans.login import Annotations, merge_logins

KEY = schema.ANNOTATION_KEY
RUN, BASE = "run", "base"
#: An operation by which device ``owner_id`` logs in as the user named in ``content``.
LOGIN = "login"
#: A bucket is condensed when its runs hold this share of its base, or when they are this many.
SHARE, MAX_RUNS = 0.5, 16
_STORED = T.StructType([*schema.OPERATION.fields, T.StructField("bucket", T.IntegerType())])
_LIST = "bucket int, kind string, batch long, rows long"


class Version(NamedTuple):
    bucket: int
    kind: str
    batch: int
    rows: int


@dataclass(frozen=True)
class ChangeStore:
    """Condensed operations and logins below one shared path.

    ``buckets`` divides the keys and is fixed for the life of the store; choose it so
    that the live operations of one bucket are some hundred megabytes.
    """

    path: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: add its run, condense the buckets that are due, list both."""
        spark = batch.sparkSession
        incoming = f"{self.path}/incoming/batch_id={batch_id}"
        batch.select(*schema.OPERATION.fieldNames()).write.mode("overwrite").parquet(incoming)
        # Read back: from here on nothing depends on the source being repeatable.
        ops = spark.read.schema(schema.OPERATION).parquet(incoming)
        ops.where(F.col("op") == LOGIN).groupBy(F.col("owner_id").alias("device_id"), F.col("content").alias("user_id")).agg(
            F.min("ts").alias("ts")).write.mode("overwrite").parquet(f"{self.path}/logins/batch_id={batch_id}")

        added = self._write(spark, ops.where(F.col("op") != LOGIN), batch_id, RUN)
        runs, bases = defaultdict(list), {}
        for v in [*self._live(spark, batch_id - 1), *added]:
            if v.kind == BASE:
                bases[v.bucket] = v
            else:
                runs[v.bucket].append(v)
        due = [v.bucket for v in added if self._is_due(runs[v.bucket], bases.get(v.bucket))]
        merged = []
        if due:
            old = [v for b in due for v in [*runs[b], *([bases[b]] if b in bases else [])]]
            merged = self._write(spark, self._read(spark, old), batch_id, BASE)
        listed = [*[v for v in added if v.bucket not in set(due)], *merged]
        spark.createDataFrame(listed, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{self._lists}/at={batch_id}")

    @staticmethod
    def _is_due(runs: list[Version], base: Version | None) -> bool:
        """Whether a bucket is to be condensed. Without a base its first run, which is condensed in itself, stands for one."""
        first, later = (base, runs) if base else (runs[0], runs[1:])
        return len(runs) >= MAX_RUNS or sum(r.rows for r in later) > SHARE * first.rows

    def _write(self, spark: SparkSession, ops: DataFrame, batch_id: int, kind: str) -> list[Version]:
        """Condense ``ops`` into one version per bucket; returns at most ``buckets`` of them."""
        # Splits a bucket with very many live operations, joins small ones.
        spread = condensed(ops).withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        path = f"{self.path}/operations/batch_id={batch_id}/kind={kind}"
        spread.write.mode("overwrite").partitionBy("bucket").parquet(path)
        counts = spark.read.schema(_STORED).parquet(path).groupBy("bucket").count().collect()
        return [Version(r["bucket"], kind, batch_id, r["count"]) for r in counts]

    @property
    def _lists(self) -> str:
        return f"{self.path}/versions"

    def _live(self, spark: SparkSession, upto: int | None = None) -> list[Version]:
        """Each bucket's newest base and the runs since, of the batches up to ``upto``: at most MAX_RUNS + 1 a bucket."""
        try:
            listed = spark.read.schema(_LIST + ", at long").parquet(self._lists).drop("at").distinct()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if upto is not None:
            listed = listed.where(F.col("batch") <= upto)
        bases = listed.where(F.col("kind") == BASE).groupBy("bucket").agg(F.max("batch").alias("_base"))
        live = listed.join(bases, "bucket", "left").where(
            F.col("_base").isNull() | (F.col("batch") > F.col("_base")) | ((F.col("kind") == BASE) & (F.col("batch") == F.col("_base"))))
        return [Version(r.bucket, r.kind, r.batch, r.rows) for r in live.orderBy("bucket", "batch").collect()]

    def _folder(self, bucket: int, kind: str, batch_id: int) -> str:
        return f"{self.path}/operations/batch_id={batch_id}/kind={kind}/bucket={bucket}"

    def _read(self, spark: SparkSession, versions: list[Version]) -> DataFrame:
        if not versions:
            return spark.createDataFrame([], schema.OPERATION)
        paths = [self._folder(v.bucket, v.kind, v.batch) for v in versions]
        return spark.read.schema(schema.OPERATION).option("basePath", f"{self.path}/operations").parquet(*paths).select(
            *schema.OPERATION.fieldNames())

    def operations(self, spark: SparkSession) -> DataFrame:
        """The operations that still matter."""
        return self._read(spark, self._live(spark))

    def favorites(self, spark: SparkSession) -> DataFrame:
        return replay_favorites(self.operations(spark))

    def notes(self, spark: SparkSession) -> DataFrame:
        return replay_notes(self.operations(spark))

    def logins(self, spark: SparkSession) -> DataFrame:
        """``(device_id, user_id, ts)``: the earliest login of each device as each user."""
        stored = spark.read.schema("device_id string, user_id string, ts timestamp_ntz").parquet(f"{self.path}/logins")
        return stored.groupBy("device_id", "user_id").agg(F.min("ts").alias("ts"))

    def annotations(self, spark: SparkSession, user_tags: DataFrame) -> Annotations:
        """Favourites, notes and tags after all logins so far: as if everything had come in one batch."""
        before = Annotations(self.favorites(spark), self.notes(spark), user_tags)
        return merge_logins(before, self.logins(spark))

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Free what finished batches up to ``upto`` have superseded.

        Only versions older than a listed base, input already applied and old lists go; a
        compaction that dies on the way can simply run again.
        """
        live = self._live(spark, upto)
        kept = {self._folder(v.bucket, v.kind, v.batch).removeprefix("file://") for v in live}
        spark.createDataFrame(live, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{self._lists}/at=-1")
        old = []
        for name, pattern in (("operations", r".*/batch_id=(\d+)/kind=\w+/bucket=\d+(?=/)"), ("incoming", r".*/batch_id=(\d+)(?=/)"),
                              ("versions", r".*/at=(\d+)(?=/)")):
            files = spark.read.schema("x int").parquet(f"{self.path}/{name}").inputFiles()
            found = {m.group(): int(m.group(1)) for f in files if (m := re.match(pattern, f))}
            old += [path for path, batch in found.items() if batch <= upto and not path.removeprefix("file://") in kept]
        for folder in old:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def start_replay(operations: DataFrame, store: ChangeStore, available_now: bool = True,
                 interval: str = "30 seconds") -> StreamingQuery:
    """Start applying a stream of operations to a store.

    No event-time window is involved, hence no watermark: operations may be late by
    any amount and still count.
    """
    writer = operations.writeStream.foreachBatch(store.apply).option(
        "checkpointLocation", f"{store.path}/checkpoint")
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
