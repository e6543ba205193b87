"""Compares registered queries with their SQL counterparts: names, row multiset."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, int):
        return float(f"{value:.12g}") if abs(value) < 2**53 else value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return float(value)


def differences(spark, db, name: str, build, sql: str, folder: str) -> list[str]:
    frame = build(spark, folder)
    ours_names = sorted(frame.columns)
    result = db.execute(sql)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != ours_names:
        return [f"{name}: columns {ours_names} != {sorted(theirs_names)}"]
    places = [theirs_names.index(c) for c in ours_names]
    theirs = Counter(tuple(_plain(row[i]) for i in places) for row in result.fetchall())
    ours = Counter(tuple(_plain(row[c]) for c in ours_names) for row in frame.collect())
    if ours == theirs:
        return []
    extra, missing = list((ours - theirs).elements()), list((theirs - ours).elements())
    return [
        f"{name}: {sum(ours.values())} rows against {sum(theirs.values())}; {len(extra)} extra, {len(missing)} missing",
        f"   columns {ours_names}",
        *[f"   extra   {row}" for row in sorted(extra, key=str)[:3]],
        *[f"   missing {row}" for row in sorted(missing, key=str)[:3]],
    ]
