"""Session defaults and the one way this package cuts a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = (
        SparkSession.builder.master(master)
        .appName("postflow")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot join key even when the split costs one more shuffle downstream.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        folder = tempfile.mkdtemp(prefix="postflow-checkpoint-")
    context.setCheckpointDir(folder)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer pieces than the session can work on, dealt out to all of them.

    For heavy work per row over few files. A table of many files is left as it is, without
    a shuffle. Only for plain scans: asking a plan with a shuffle would run it.
    """
    workers = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(workers) if scan.rdd.getNumPartitions() < workers else scan


def working_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, in storage every executor can reach."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """While a table is written: no batch for a Python worker has more rows or bytes; tighter settings stay."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, most in names.items():
            held = before[name].lower().removesuffix("b")
            spark.conf.set(name, str(min(int(held), most) if held.isdigit() and int(held) else most))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared checkpoint folder and go on from there.

    Used where a result must be computed once only (a paid scorer, a sort whose row
    numbers are read twice) and between the rounds of an iterative operator. A written
    table outlives lost executors, and later steps read only the columns they need and
    know its size.
    """
    spark = df.sparkSession
    path = working_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote, once all that reads them is written itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("cut-"):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
