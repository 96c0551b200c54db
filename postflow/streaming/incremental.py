"""Streaming forms of the three incremental operators.

Each micro-batch runs the batch operator against the state that the batches before it left,
for the keys it names, and writes what it changed. Changes lie in one folder per batch
number, so a batch that is retried after a failure starts from the same state and
overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.prefilter import POSTING_KEY
from ..operators.reconcile import PAYLOAD, fresh_payloads, reconcile_polls, with_payloads
from ..operators.tracking import fold_events
from ..schemas import TABLES, struct_of
from ..session import cut


def _run_all(stream: DataFrame, root: str, step: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class ChangeTable:
    """A table as the changes that each batch made, by key, on top of a base.

    A row of a later batch replaces that of an earlier one; without a key rows are only added.
    A batch that is retried reads what the batches before it left and writes its own changes
    anew.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: list[str] | None):
        self.spark, self.path, self.schema, self.key = spark, path, struct_of(ddl), key

    def _folders(self) -> dict[str, list[int]]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"base": [], "batch": []}
        for status in files.listStatus(hadoop) if files.exists(hadoop) else []:
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and (kind == "batch" or files.exists(status.getPath().suffix("/_SUCCESS"))):
                found[kind].append(int(number))
        return found

    def before(self, number: int) -> DataFrame:
        """The table as the batches before `number` left it."""
        found = self._folders()
        base = max((n for n in found["base"] if n < number), default=-1)
        names = [f"base={base}"] * (base >= 0) + [f"batch={n}" for n in found["batch"] if base < n < number]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        parts = [
            self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").withColumn("_batch", F.lit(int(name.split("=")[1])))
            for name in names
        ]
        every = reduce(DataFrame.unionByName, parts)
        if len(parts) == 1 or self.key is None:
            return every.drop("_batch")
        others = [c for c in self.schema.fieldNames() if c not in self.key]
        latest = every.groupBy(*self.key).agg(F.max_by(F.struct(*others), "_batch").alias("_row"))
        return latest.select(*self.key, "_row.*").select(*self.schema.fieldNames())

    def now(self) -> DataFrame:
        return self.before(max(self._folders()["batch"], default=-1) + 1)

    def write(self, changes: DataFrame, number: int) -> None:
        changes.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def compact(self, number: int) -> None:
        """Before batch `number`: all that came before it as one base, and the folders that this replaces gone."""
        last = number - 1
        if last not in self._folders()["base"]:
            self.before(number).write.mode("overwrite").parquet(f"{self.path}/base={last}")
        files = None
        for kind, numbers in self._folders().items():
            for n in numbers:
                if n < last or (kind == "batch" and n == last):
                    folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={n}")
                    files = files or folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
                    files.delete(folder, True)


OUTCOMES = "job_key STRING, seq BIGINT, action STRING, changed BOOLEAN, reason STRING"


def fold_event_stream(log: DataFrame, root: str, compact_every: int = 16) -> dict[str, DataFrame]:
    """Folds a stream of actions and steps; returns applications, events and outcomes.

    `log` has the columns of `fold_events`; `seq` rises from batch to batch. State is kept by
    job key: a batch reads the applications and steps of the jobs it names and writes the
    applications it changed, the steps it added and its outcomes. An application that an undo
    removes stays in the changes as `gone`. No group is gathered, so a job may have any share
    of a batch. Called again with the same `root` it goes on from its checkpoint.
    """
    spark = log.sparkSession
    applications = ChangeTable(spark, f"{root}/applications", TABLES["applications"], ["job_key"])
    events = ChangeTable(spark, f"{root}/application_events", TABLES["application_events"], None)
    outcomes = ChangeTable(spark, f"{root}/outcomes", OUTCOMES, None)
    live = F.col("status") != "gone"

    def step(batch: DataFrame, number: int) -> None:
        if number and number % compact_every == 0:
            applications.compact(number)
            events.compact(number)
        rows = cut(batch)  # read several times
        jobs = cut(rows.select("job_key").distinct())
        held = cut(applications.before(number).where(live).join(jobs, "job_key", "left_semi"))
        fold = fold_events(rows, held, events.before(number).join(jobs, "job_key", "left_semi"))
        after = cut(fold.applications.select(*held.columns))
        gone = held.join(after, "job_key", "left_anti").withColumn("status", F.lit("gone"))
        applications.write(after.exceptAll(held).unionByName(gone), number)
        events.write(fold.added, number)
        outcomes.write(fold.outcomes, number)

    _run_all(log, root, step)
    return {"applications": applications.now().where(live), "events": events.now(), "outcomes": outcomes.now()}


def reconcile_stream(
    landed: DataFrame, root: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], compact_every: int = 16
) -> DataFrame:
    """Stored postings, with their payloads, after every landed response so far.

    `parse` turns landed rows into (snapshot rows, fetch runs), both with `fetched_at`. A
    batch may hold several polls of a board. There is no watermark: a posting is missing
    only from a complete snapshot, never because time passed. A batch writes the postings
    that it changed and the payloads that they are the first to refer to.
    """
    spark = landed.sparkSession
    postings = ChangeTable(spark, f"{root}/postings", TABLES["postings"], POSTING_KEY)
    payloads = ChangeTable(spark, f"{root}/payloads", TABLES["payloads"], PAYLOAD)

    def step(batch: DataFrame, number: int) -> None:
        if number and number % compact_every == 0:
            postings.compact(number)
            payloads.compact(number)
        snapshots, runs = (cut(df) for df in parse(cut(batch)))
        before = cut(postings.before(number))
        after = cut(reconcile_polls(before, snapshots, runs).select(*before.columns))
        payloads.write(fresh_payloads(before, after, snapshots), number)
        postings.write(after.exceptAll(before), number)  # narrow rows: payloads are apart

    _run_all(landed, root, step)
    return with_payloads(postings.now(), payloads.now())


# Keys that are remembered for good lie on disk, not on the heap, and are uploaded as changes.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def first_sightings_stream(postings: DataFrame) -> DataFrame:
    """The stream without keys seen before. Memory is for good, so the state has no time limit."""
    for name, value in STATE_STORE.items():
        postings.sparkSession.conf.set(name, value)
    return postings.dropDuplicates(POSTING_KEY)


def write_sightings(postings: DataFrame, root: str) -> DataFrame:
    """Runs `first_sightings_stream` over everything available and returns what it kept."""
    query = (
        first_sightings_stream(postings).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{root}/progress").option("path", f"{root}/sightings")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return postings.sparkSession.read.schema(postings.schema).parquet(f"{root}/sightings")
