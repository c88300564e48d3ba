"""Run a registered query in Spark and its oracle in DuckDB; compare as the
driver does (columns sorted by name, order-insensitive, floats to 6 digits)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from kbspark.session import TABLES

SF_SMALL = "/root/testdata/sf0.001"


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records")]
    return cols, sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, queries: dict, oracle: dict):
    sdf = queries[name](spark, sf_dir).toPandas()
    odf = duck(sf_dir).execute(oracle[name]).df()
    sc, sr = rows(sdf)
    oc, orr = rows(odf)
    return {"name": name, "cols_match": sc == oc, "spark_cols": sc, "oracle_cols": oc,
            "spark_rows": len(sr), "oracle_rows": len(orr), "match": sc == oc and sr == orr,
            "diff": [r for r in sr if r not in set(orr)][:3] if sc == oc and sr != orr else None,
            "missing": [r for r in orr if r not in set(sr)][:3] if sc == oc and sr != orr else None}
