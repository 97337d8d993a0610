"""Order-free comparison of a Spark result with an SQL result."""

import math

import numpy as np
import pandas as pd


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([plain(v) for v in value])
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)) or type(value).__name__ == "Decimal":
        return None if math.isnan(float(value)) else f"{float(value):.9g}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=lambda t: tuple((v is None, v or "") for v in t))


def same(spark_df, sql, con):
    ours, theirs = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y
