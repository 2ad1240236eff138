"""Row sets of a Spark result and of its SQL, made comparable."""

import math
import os

import duckdb


def views(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if type(value).__name__ in ("NAType", "NaTType"):
        return None
    if type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return int(value) if float(value).is_integer() else round(float(value), 9)
    if type(value).__name__.startswith(("int", "uint")):
        return int(value)
    return str(value)


def rows(frame):
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[sorted(frame.columns)].itertuples(index=False))
