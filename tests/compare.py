"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(frame):
    """Rows as sorted tuples over the columns in name order, with kinds of the columns."""
    import numpy as np
    import pandas as pd

    cols = sorted(frame.columns)
    kinds, data = [], []
    for c in cols:
        s = frame[c]
        values = []
        for v in s.tolist():
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
                values.append(None)
            elif hasattr(v, "isoformat"):
                values.append(pd.Timestamp(v).isoformat())
            elif isinstance(v, (bool, np.bool_)):
                values.append(bool(v))
            elif isinstance(v, (list, np.ndarray)):
                values.append(str(list(v)))
            else:
                values.append(v)
        present = [v for v in values if v is not None]
        kinds.append("text" if present and isinstance(present[0], str) else "number")
        data.append(values)
    rows = sorted(zip(*data), key=repr) if data else []
    return cols, kinds, [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
                               for v in r) for r in rows]


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


# Spark type -> DuckDB type, where the check tool compares schemas.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def compare(spark, con, folder, build, sql):
    """Empty text if rows and schemas agree, else what differs."""
    df = build(spark, folder)
    left = canonical(df.toPandas())
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    right = canonical(rel.df())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    odd = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t, t) != types[c]}
    if odd:
        return f"types {odd}"
    if len(left[2]) != len(right[2]):
        return f"rows {len(left[2])} != {len(right[2])}"
    for a, b in zip(sorted(left[2], key=repr), sorted(right[2], key=repr)):
        if a != b:
            return f"values {dict(zip(left[0], a))} != {dict(zip(left[0], b))}"
    return ""


def main():
    sys.path.insert(0, ROOT)
    from emberfield.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    folder = f"/root/testdata/{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name, build in queries.items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracle:
                result = compare(spark, con, folder, build, oracle[name]) or "ok"
            else:
                result = f"rows only: {build(spark, folder).count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += result != "ok" and not result.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.2f}s  {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
