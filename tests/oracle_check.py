"""Run registered queries against DuckDB: ``python tests/oracle_check.py SF_DIR [name…]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bool):
        return bool(v)
    return v


def _kind(type_name: str) -> str:
    t = type_name.lower()
    for kind, words in {
        "int": ("bigint", "int", "long", "smallint", "tinyint"),
        "float": ("double", "float"),
        "str": ("varchar", "string"),
        "bool": ("boolean",),
    }.items():
        if t in words or t == "integer":
            return "int" if t == "integer" else kind
    return t


def compare(df, con, sql: str) -> str | None:
    """None when rows, columns and value kinds agree; else what differs."""
    columns = sorted(df.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: _kind(str(d[1])) for d in res.description}
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    ours = {n: _kind(t) for n, t in df.dtypes}
    bad = {n: (ours[n], kinds[n]) for n in columns if ours[n] != kinds[n]}
    if bad:
        return f"types {bad}"
    at = [names.index(c) for c in columns]
    want = [tuple(_plain(r[i]) for i in at) for r in res.fetchall()]
    if len(rows) != len(want):
        return f"{len(rows)} rows against {len(want)}"
    from collections import Counter

    if Counter(rows) != Counter(want):
        sa, sb = set(rows), set(want)
        return f"{len(sa - sb)} rows differ: {sorted(sa - sb, key=repr)[:3]} against {sorted(sb - sa, key=repr)[:3]} ({columns})"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from foldspark.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in names or list(queries):
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:400]}"
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - t:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
