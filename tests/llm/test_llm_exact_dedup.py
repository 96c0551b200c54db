import os
import re

import pytest
from llm_cases import ROWS, SF, documents, empty, given, rows_of
from pyspark.sql import functions as F

from postflow.llm import exact_dedup as E
from postflow.llm.queries import QUERIES


def brute(rows):
    """doc_id, keep_id, group_size, kept by comparing every pair of texts."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t in rows]
    out = []
    for (key, _), own in zip(rows, norm):
        group = [rows[k] for k in range(len(rows)) if norm[k] == own]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out.append((key, keep, len(group), key == keep))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept")


def test_edge_rows(spark):
    assert rows_of(E.deduplicate(documents(spark)), *COLUMNS) == brute([r[:2] for r in ROWS])
    assert E.deduplicate(empty(spark)).collect() == []


def test_ties_and_lengths(spark):
    rows = [(9, "a b", "x"), (3, "ab", "x"), (5, "a  b", "x"), (4, "a\t\vb", "x"), (8, "A b", "x"), (2, "a\u00a0b", "x")]
    found = rows_of(E.deduplicate(documents(spark, rows)), *COLUMNS)
    assert found == brute([r[:2] for r in rows])
    assert (3, 4, 4, False) in found


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_texts_that_share_a_digest_are_told_apart(spark, files_per_batch):
    def weak(text, turn):
        return F.substring(E.sha256_digest(text, turn), 1, 1)

    rows = [(k, f"text {k % 40}" + " " * (k % 3), "x") for k in range(120)]
    docs = documents(spark, rows).repartition(6)
    assert rows_of(E.deduplicate(docs, weak, files_per_batch), *COLUMNS) == brute([r[:2] for r in rows])


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    def land(rows, arrival):
        df = spark.createDataFrame(rows, "doc_id long, digest string, locator string, n_points long")
        df.withColumn("arrival", F.lit(arrival).cast("long")).write.mode("append").parquet(f"{tmp_path}/landed")
        return spark.read.parquet(f"{tmp_path}/landed")

    def state(landed):
        return rows_of(E.keyed_state(landed, str(tmp_path)), "digest", "rep_id", "rows", "keep_id")

    assert state(land([(7, "a", "", 1), (8, "b", "", 1)], 0)) == [("a", 7, 1, 7), ("b", 8, 1, 8)]
    # A smaller doc_id that comes later does not take the identifier over, but it is the one that stays; a longer text stays before it.
    assert state(land([(1, "a", "", 1), (2, "c", "", 1), (9, "b", "", 2)], 1)) == [("a", 7, 2, 1), ("b", 8, 2, 9), ("c", 2, 1, 2)]


def test_one_row_of_each_group_stays(spark):
    kept = E.kept_documents(documents(spark))
    assert kept.columns == documents(spark).columns
    assert rows_of(kept, "doc_id") == rows_of(
        documents(spark).where("doc_id IN (1, 4, 5, 7) OR (doc_id IS NULL AND text IS NOT NULL)"), "doc_id"
    )


def test_query_against_brute_force(spark):
    docs = given("documents")
    expected = brute(list(zip(docs.doc_id.tolist(), docs.text.tolist())))
    assert rows_of(QUERIES["op8_exact_dedup"](spark, SF), *COLUMNS) == expected


def test_a_row_repeated_very_often(spark):
    """The first text of a digest is held once, so repeats are compared once each."""
    docs = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"))
    found = E.deduplicate(docs).groupBy("keep_id", "group_size", "kept").count().collect()
    assert [tuple(r) for r in found] == [(7, 40_000, True, 40_000)]


def test_no_state_store_stays_open(spark, tmp_path):
    """Open stores hold native memory, which would grow with the number of partitions."""
    rows = spark.range(400).select("id", F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    landed = rows.select("doc_id", "digest", F.lit("").alias("locator"), F.lit(1).cast("long").alias("n_points"), F.lit(0).cast("long").alias("arrival"))
    landed.write.parquet(f"{tmp_path}/landed")
    fds = f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/fd"

    def stores():
        links = [os.readlink(f"{fds}/{n}") for n in os.listdir(fds) if os.path.lexists(f"{fds}/{n}")]
        return {link for link in links if "StateStoreId(" in link and link.endswith("/LOCK")}

    before = stores()
    state = E.keyed_state(spark.read.parquet(f"{tmp_path}/landed"), str(tmp_path))
    assert stores() <= before
    assert state.count() == 400
