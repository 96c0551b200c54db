"""Rows that every operator must bear, and access to the given tables."""

import duckdb
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = "Word after word, on and on. " * 40_000
ROWS = [
    (1, "One text of the table, nothing more.", "en"), (2, None, "en"), (3, "", "fr"), (4, " \t\n ", None),
    (5, LONG, "en"), (6, "One text of the table, nothing more.", "en"), (6, "One text of the table, nothing more.", "en"),
    (7, "…!? 123 漢字 🙂 \u0301", "de"), (None, "A row without a name.", "en"), (None, None, None),
]
# Names that the operators use inside.
CLASHING = "digest class fingerprint tile root score _id shard bucket rank norm keep_id _keep_id offending".split()


def documents(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df


def empty(spark):
    return documents(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def given(name, sf_dir=SF):
    """All rows of a given table."""
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/{name}.parquet'").df()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
