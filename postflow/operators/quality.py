"""Data-quality checks. Each returns the violating rows; an empty frame is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..schemas import struct_of


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values carried by more than one row, with how many rows carry them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def check_vocabulary(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Values of `column` outside `vocabulary` (nulls are allowed) and how often each occurs."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(vocabulary))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def check_reference(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows whose non-null key (child column -> parent column) has no parent."""
    targets = parent.select(*[F.col(p).alias(f"_parent_{c}") for c, p in keys.items()]).distinct()
    present = child
    for c in keys:
        present = present.where(F.col(c).isNotNull())
    condition = [F.col(c) == F.col(f"_parent_{c}") for c in keys]
    return present.join(targets, condition, "left_anti")


def check_bands(bands: list[tuple[str, int, int]]) -> list[str]:
    """What is wrong with a score scale: it must run 0 to 100 without gap or overlap."""
    problems = [f"{name}: {low}-{high} is reversed" for name, low, high in bands if low > high]
    ordered = sorted(bands, key=lambda band: band[1])
    if not ordered or ordered[0][1] != 0 or ordered[-1][2] != 100:
        problems.append("the bands do not cover 0 to 100")
    problems += [
        f"{after[0]}: starts at {after[1]} after a band ending at {before[2]}"
        for before, after in zip(ordered, ordered[1:])
        if after[1] != before[2] + 1
    ]
    return problems


def band_gaps(bands: DataFrame) -> DataFrame:
    """The same check over a bands frame (name, low, high): one row per broken boundary.

    Boundaries are matched by value (`low` against every `high + 1`), which needs no
    ordering of the whole frame.
    """
    ends = bands.select((F.col("high") + 1).alias("start")).distinct()
    no_previous = bands.where("low <> 0").join(ends, F.col("low") == F.col("start"), "left_anti")
    starts = bands.select((F.col("low") - 1).alias("stop")).distinct()
    no_next = bands.where("high <> 100").join(starts, F.col("high") == F.col("stop"), "left_anti")
    reversed_ = bands.where("low > high")
    repeated = bands.groupBy("low").agg(F.min("name").alias("name"), F.max("high").alias("high"),
                                        F.count(F.lit(1)).alias("n")).where("n > 1")

    def report(df: DataFrame, problem: str) -> DataFrame:
        return df.select("name", "low", "high", F.lit(problem).alias("problem"))

    return (
        report(no_previous, "no band ends just below")
        .unionByName(report(no_next, "no band starts just above"))
        .unionByName(report(reversed_, "bounds reversed"))
        .unionByName(report(repeated, "low shared by several bands"))
    )


def check_schema(df: DataFrame, expected: T.StructType) -> list[str]:
    """Columns that are missing from `df` or have another type than declared."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for f in expected.fields:
        if f.name not in actual:
            problems.append(f"missing column {f.name}")
        elif actual[f.name].simpleString() != f.dataType.simpleString():
            problems.append(
                f"column {f.name} is {actual[f.name].simpleString()}, "
                f"declared {f.dataType.simpleString()}"
            )
    return problems


def check_tables(frames: dict[str, DataFrame], declared: dict[str, str]) -> dict[str, list[str]]:
    """Schema problems per declared table; a table that is absent altogether is one of them."""
    report = {
        name: check_schema(frames[name], struct_of(ddl)) if name in frames else ["missing table"]
        for name, ddl in declared.items()
    }
    return {name: problems for name, problems in report.items() if problems}
