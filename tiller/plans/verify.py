"""Side-by-side check of a registered query against its SQL twin.

Mirrors the correctness gate: same column names, same row count, same
multiset of rows (order-insensitive).  Values are compared exactly; the
register already rounds floating outputs on both sides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (AttributeError, ValueError):
            pass
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(rec[i]) for i in order) for rec in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in t))


_SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
                "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "date": "DATE",
                "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def _spark_type(t) -> str:
    s = t.simpleString()
    if s.startswith("decimal"):
        return "DECIMAL"
    if s.startswith("array"):
        return "LIST"
    return _SPARK_TYPES.get(s, s.upper())


def _duck_type(t: str) -> str:
    t = t.upper()
    if t.startswith("DECIMAL"):
        return "DECIMAL"
    if t.endswith("[]") or t.startswith("LIST"):
        return "LIST"
    return {"NUMBER": "DOUBLE", "STRING": "VARCHAR"}.get(t, t)


@dataclass
class Result:
    name: str
    ok: bool
    spark_rows: int = 0
    sql_rows: int = 0
    problems: list[str] = field(default_factory=list)


def compare(name: str, spark, sf_dir: str, con=None, spark_df=None) -> Result:
    from tiller.plans import register

    con = con or duckdb_connection(sf_dir)
    sdf = spark_df if spark_df is not None else register.SPARK[name](spark, sf_dir)
    s_cols = sdf.columns
    s_recs = [tuple(r) for r in sdf.collect()]
    res = Result(name, True, spark_rows=len(s_recs))
    sql = register.SQL.get(name)
    if sql is None:
        res.problems.append("no SQL twin (row count only)")
        return res
    cur = con.execute(sql)
    q_cols = [d[0] for d in cur.description]
    q_recs = cur.fetchall()
    res.sql_rows = len(q_recs)
    if sorted(s_cols) != sorted(q_cols):
        res.ok = False
        res.problems.append(f"columns differ: spark={sorted(s_cols)} sql={sorted(q_cols)}")
        return res
    s_types = {f.name: _spark_type(f.dataType) for f in sdf.schema.fields}
    q_types = {d[0]: _duck_type(str(d[1])) for d in cur.description}
    diff_types = {c: (s_types[c], q_types[c]) for c in s_cols if s_types[c] != q_types.get(c)}
    if diff_types:
        res.ok = False
        res.problems.append(f"types differ: {diff_types}")
    if len(s_recs) != len(q_recs):
        res.ok = False
        res.problems.append(f"row count differs: spark={len(s_recs)} sql={len(q_recs)}")
    a, b = _rows(s_recs, s_cols), _rows(q_recs, q_cols)
    if a != b:
        res.ok = False
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res.problems.append(f"values differ, first: {diff}")
    return res


def main(argv: list[str] | None = None) -> int:
    """``python -m tiller.plans.verify SF_DIR [query ...]``: compare every (or
    the named) registered query with its SQL twin; exit status 1 on any
    mismatch."""
    import sys
    import time

    from tiller.plans import register
    from tiller.session import local_session

    args = sys.argv[1:] if argv is None else argv
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or sorted(register.SPARK)
    spark = local_session()
    con = duckdb_connection(sf_dir)
    bad = 0
    for name in names:
        t0 = time.perf_counter()
        res = compare(name, spark, sf_dir, con)
        bad += not res.ok
        status = "ok " if res.ok else "BAD"
        print(f"{status} {name:32s} {time.perf_counter() - t0:6.2f}s "
              f"rows={res.spark_rows}/{res.sql_rows} {'; '.join(res.problems)}", flush=True)
    print(f"{len(names) - bad}/{len(names)} queries match their SQL twins")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
