"""Compares a query with its SQL on the same Parquet tables."""

import math
import os

import duckdb


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of_sql(sql, sf):
    db = duckdb.connect()
    for name in os.listdir(sf):
        db.execute(f"create view {name[:-8]} as select * from '{sf}/{name}'")
    cursor = db.execute(sql)
    names = [x[0] for x in cursor.description]
    return sorted(names), sorted(tuple(canonical(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(canonical(r[c]) for c in names) for r in df.collect())
