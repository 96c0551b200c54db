"""Runs a registered query and its SQL side by side."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, query, sql):
    """None when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = oracle(sf_dir)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected_names, expected = rows_of(columns, result.fetchall())
    if names != expected_names:
        return f"columns {names} against {expected_names}"
    if got != expected:
        extra = [r for r in got if r not in set(expected)][:3]
        missing = [r for r in expected if r not in set(got)][:3]
        return f"{len(got)} rows against {len(expected)}; only here {extra}; only there {missing}"
    return None if got else "no rows"
