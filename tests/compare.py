"""Run registered queries next to their SQL and report differences.

Usage: python tests/compare.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        # Close values must land on one text; the last digits depend on summation order.
        return f"{float(v) + 0.0:.9g}"
    return str(v)


def rows_of(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in place) for r in rows)


def difference(got_cols, got, want_cols, want):
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(set(got_cols) ^ set(want_cols))}"
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ; {sorted(got_cols)}: {wrong[0][0]} against {wrong[0][1]}"
    return None


def check(spark, con, name, plan, sql, folder):
    frame = plan(spark, folder)
    got = frame.collect()
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    want_cols = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    spark_types = {n: t for n, t in frame.dtypes}
    duck_types = {d[0]: str(d[1]).upper() for d in cursor.description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN"}
    bad = [(c, t, duck_types.get(c)) for c, t in spark_types.items()
           if c in duck_types and same.get(t) not in (duck_types[c], None) and duck_types[c] not in ("NUMBER", "STRING")]
    odd = [(c, t) for c, t in spark_types.items() if t not in same]
    note = difference(frame.columns, got, want_cols, want)
    if note is None and not got:
        note = "no rows"
    return note or (f"types {bad}" if bad else None) or (f"odd types {odd}" if odd else None)


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    import __spark_entry__ as entry
    from quaymart.session import local_session
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    checks = entry.oracle_sql()
    failed = 0
    for name, plan in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            note = check(spark, con, name, plan, checks.get(name), folder)
        except Exception as error:  # noqa: BLE001
            note = f"{type(error).__name__}: {str(error)[:700]}"
        failed += note is not None
        print(f"{'FAIL' if note else 'ok  '} {name:40s} {time.time() - start:6.2f}s {'' if name in checks else '(rows only) '}{note or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
