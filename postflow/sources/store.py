"""Stored tables: Parquet under versioned folders, written and then switched to.

A run writes its tables to a new version and only then names that version current, so a
lost executor or a failed run leaves the previous version in force.

Postings are stored in parts, by source and a hash of the board. A version holds the parts
that differ from the version before, told by sums over row hashes, and lists for all others
which version has them: a poll of a few boards rewrites their parts only. Payloads are only
ever added to; a version holds those that it was first to refer to.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import TABLES, struct_of
from ..session import cut

# Columns worth partitioning the files by: values are few and filters name them.
PARTITIONED_BY = {"digest_appearances": ["digest_date"], "fetch_runs": ["source"]}
# Parts per source that the boards are dealt to.
PARTS = 64
_PARTS_OF = "source STRING, part INT, version INT, n BIGINT, mark DECIMAL(38,0), mixed BIGINT"


@dataclass(frozen=True)
class State:
    """The stored tables as frames."""

    companies: DataFrame
    postings: DataFrame
    payloads: DataFrame
    jobs: DataFrame
    scores: DataFrame
    applications: DataFrame
    application_events: DataFrame
    digest_appearances: DataFrame
    fetch_runs: DataFrame
    candidate_companies: DataFrame
    new_payloads: DataFrame  # payloads that no version holds yet

    def all_payloads(self) -> DataFrame:
        return self.payloads.unionByName(self.new_payloads)

    def with_(self, **frames: DataFrame) -> State:
        """The same state with some tables replaced."""
        return replace(self, **frames)

    def frames(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def empty_state(spark: SparkSession) -> State:
    """Every table with its declared columns and no rows."""
    frames = {name: spark.createDataFrame([], struct_of(ddl)) for name, ddl in TABLES.items()}
    return State(**frames, new_payloads=frames["payloads"])


def _file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def is_written(spark: SparkSession, folder: str) -> bool:
    fs, path = _file_system(spark, folder)
    return fs.exists(path)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions under `root`, oldest first. A version is complete once marked."""
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        return []
    marks = [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("CURRENT-")]
    return sorted(int(m.removeprefix("CURRENT-")) for m in marks)


def _manifest(spark: SparkSession, root: str, number: int) -> list:
    """Which version holds each part of the postings: a row per part, few whatever the postings."""
    return spark.read.schema(struct_of(_PARTS_OF)).parquet(f"{root}/v{number}/postings_parts").collect()


def _write_postings(spark: SparkSession, root: str, postings: DataFrame, number: int, before: int | None, parts: int) -> None:
    """Writes the parts that differ from version `before` and lists all parts."""
    board = F.pmod(F.xxhash64("company_slug"), F.lit(parts)).cast("int")
    dealt = cut(postings.withColumn("part", board))
    row = F.xxhash64(*postings.columns)
    found = dealt.groupBy("source", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("mark"), F.bit_xor(row).alias("mixed")).collect()
    held = {(r["source"], r["part"]): r for r in _manifest(spark, root, before)} if before else {}
    rows, fresh = [], []
    for r in found:
        old = held.get((r["source"], r["part"]))
        same = old is not None and (old["n"], old["mark"], old["mixed"]) == (r["n"], r["mark"], r["mixed"])
        rows.append((r["source"], r["part"], old["version"] if same else number, r["n"], r["mark"], r["mixed"]))
        if not same:
            fresh.append((r["source"], r["part"]))
    if fresh:
        touched = spark.createDataFrame(fresh, "source STRING, part INT")
        differing = dealt.join(F.broadcast(touched), ["source", "part"])  # `parts` rows per source at most
        differing.write.partitionBy("source", "part").mode("overwrite").parquet(f"{root}/postings/version={number}")
    spark.createDataFrame(rows, struct_of(_PARTS_OF)).coalesce(1).write.mode("overwrite").parquet(f"{root}/v{number}/postings_parts")


def _read_postings(spark: SparkSession, root: str, number: int) -> DataFrame:
    schema = struct_of(TABLES["postings"])
    folders = sorted({
        f"{root}/postings/version={r['version']}/source={r['source']}/part={r['part']}" for r in _manifest(spark, root, number)
    })
    if not folders:
        return spark.createDataFrame([], schema)
    stored = spark.read.option("basePath", f"{root}/postings").schema(schema).parquet(*folders)
    return stored.select(*schema.fieldNames())


def write_state(spark: SparkSession, root: str, state: State, parts: int = PARTS) -> int:
    """Writes all tables as the next version and makes it current. Returns its number.

    `parts` is the number of parts per source that boards are dealt to.
    """
    known = versions(spark, root)
    number = known[-1] + 1 if known else 1
    for name, df in state.frames().items():
        if name in ("postings", "payloads"):
            continue
        path, table = (f"payloads/version={number}", "payloads") if name == "new_payloads" else (f"v{number}/{name}", name)
        writer = df.select(*struct_of(TABLES[table]).fieldNames()).write.mode("overwrite")
        writer.partitionBy(*PARTITIONED_BY.get(table, [])).parquet(f"{root}/{path}")
    postings = state.postings.select(*struct_of(TABLES["postings"]).fieldNames())
    _write_postings(spark, root, postings, number, known[-1] if known else None, parts)
    fs, path = _file_system(spark, root)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"CURRENT-{number}")).close()
    return number


def read_state(spark: SparkSession, root: str, version: int | None = None) -> State:
    """The current version, or the one named; an empty state where nothing was written."""
    known = versions(spark, root)
    if not known:
        return empty_state(spark)
    number = version or known[-1]
    frames = {
        name: spark.read.schema(struct_of(ddl)).parquet(f"{root}/v{number}/{name}").select(*struct_of(ddl).fieldNames())
        for name, ddl in TABLES.items() if name not in ("postings", "payloads")
    }
    payloads = struct_of(TABLES["payloads"])
    added = spark.read.option("basePath", f"{root}/payloads").schema(payloads).parquet(
        *[f"{root}/payloads/version={n}" for n in known if n <= number])
    return State(
        **frames, postings=_read_postings(spark, root, number), payloads=added.select(*payloads.fieldNames()),
        new_payloads=spark.createDataFrame([], payloads),
    )


def write_digest(entries: DataFrame, path: str) -> None:
    """The digest as JSON rows, one folder per section, ordered by position within each."""
    entries.sortWithinPartitions("section", "position").write.mode("overwrite").partitionBy("section").json(path)
