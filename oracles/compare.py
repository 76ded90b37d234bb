"""Run registered queries and their SQL side by side and report differences.

    python -m oracles.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from chalkline.plans.registry import queries
from oracles.sql import oracle_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(body, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = queries()[name](spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracle_sql()[name])
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    kinds = dict(df.dtypes)
    types = {d[0]: str(d[1]) for d in cur.description}
    pair = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    odd = {c: (kinds[c], types[c]) for c in got_names if pair.get(kinds[c]) != types[c] and types[c] != "INTEGER"}
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; e.g. {list(set(got) ^ set(want))[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"values {[(n, a, b) for n, a, b in zip(got_names, g, w) if a != b]} key {g[:9]}"
    if odd:
        return f"types {odd}"
    return None


def main() -> int:
    from chalkline.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    oracle = oracle_sql()
    bad = 0
    for name in names or list(queries()):
        if name not in oracle:
            print(f"{name:40s} no SQL")
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        bad += problem is not None
        print(f"{name:40s} {'ok' if problem is None else 'DIFF ' + problem} {time.time() - start:.1f}s", flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
