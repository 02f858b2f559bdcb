"""Run registered queries against their DuckDB oracles and compare every row."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def kind(value):
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def normal(rows):
    def cell(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return v

    out = [tuple(cell(v) for v in r) for r in rows]
    return sorted(out, key=repr)


DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def compare(df, con, sql) -> list[str]:
    """Problems found; none when both sides agree in columns, types and rows."""
    cols = sorted(df.columns)
    cur = con.execute(sql)
    duck_cols = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    if sorted(duck_cols) != cols:
        return [f"columns differ: spark {cols} duck {sorted(duck_cols)}"]
    problems = []
    types = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        want = DUCK_TYPES.get(types[f.name].upper())
        if want != f.dataType.simpleString():
            problems.append(f"type of {f.name}: spark {f.dataType.simpleString()} duck {types[f.name]}")
    pos = [duck_cols.index(c) for c in cols]
    want_rows = normal([tuple(r[i] for i in pos) for r in duck_rows])
    got_rows = normal([tuple(r) for r in df.select(*cols).collect()])
    if len(want_rows) != len(got_rows):
        problems.append(f"row count: spark {len(got_rows)} duck {len(want_rows)}")
    if want_rows != got_rows:
        missing, extra = set(want_rows) - set(got_rows), set(got_rows) - set(want_rows)
        problems.append(f"{len(extra)} rows only in spark, {len(missing)} only in duck")
        for name, rows in (("spark", extra), ("duck", missing)):
            for r in sorted(rows, key=repr)[:3]:
                problems.append(f"  {name}: {dict(zip(cols, r))}")
    return problems


def main(argv):
    import __spark_entry__ as entry
    from dinefold.session import local_session

    sf = argv[1]
    spark = local_session(8)
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[2:] or list(queries)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf)
            if name not in oracles:
                n = df.count()
                print(f"-- {name}: no oracle, {n} rows, {time.time() - t0:.1f}s", flush=True)
                continue
            problems = compare(df, con, oracles[name])
            n = con.execute(f"select count(*) from ({oracles[name]}) q").fetchall()[0][0] if not problems else "?"
        except Exception as exc:  # report and go on
            problems, n = [f"{type(exc).__name__}: {str(exc)[:1200]}"], "?"
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name}: {n} rows, {time.time() - t0:.1f}s", flush=True)
        for p in problems:
            print("     ", p)
        if n == 0:
            print("      EMPTY RESULT")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv)))
