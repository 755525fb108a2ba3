"""Run queries next to their DuckDB twins and compare rows exactly.

usage: check_oracle.py [--sf DIR] [--only a,b,...] [--prefix p]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", float(v))
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


def kind(t: str) -> str:
    t = t.lower()
    if t.startswith(("decimal", "hugeint", "uhugeint")):
        return t
    names = {"int": "int", "integer": "int", "bigint": "bigint", "long": "bigint", "double": "double",
             "string": "string", "varchar": "string", "boolean": "bool", "date": "date",
             "timestamp": "timestamp", "timestamp_ntz": "timestamp"}
    return names.get(t, t)


def compare(spark, con, entry, sf, verbose=True) -> bool:
    t0 = time.time()
    df = entry.run(spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    t1 = time.time()
    if entry.sql is None:
        print(f"rows  {entry.name:<34} {len(rows):>8} rows {t1 - t0:6.1f}s")
        return len(rows) > 0
    rel = con.execute(entry.sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    t2 = time.time()
    problems = []
    if cols != sorted(names):
        problems.append(f"columns differ: only spark {sorted(set(cols) - set(names))}, only sql {sorted(set(names) - set(cols))}")
    for f in df.schema.fields:
        a, b = kind(f.dataType.simpleString()), kind(types.get(f.name, "?"))
        if a != b:
            problems.append(f"type {f.name}: spark {a} sql {b}")
    if len(rows) != len(want):
        problems.append(f"row count spark {len(rows)} sql {len(want)}")
    key = lambda r: tuple((v is None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in r)
    try:
        a, b = sorted(map(repr, rows)), sorted(map(repr, want))
    except Exception as exc:  # pragma: no cover
        a, b = [], [str(exc)]
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"values differ: {len(only_a)} vs {len(only_b)} unmatched rows")
        if verbose and cols == sorted(names):
            da = {r: None for r in only_a}
            ra = sorted((r for r in rows if repr(r) in da), key=repr)[:400]
            db = {r: None for r in only_b}
            rb = sorted((r for r in want if repr(r) in db), key=repr)[:400]
            seen = {}
            for x, y in zip(ra, rb):
                for c, u, v in zip(cols, x, y):
                    if u != v and repr(u) != repr(v):
                        seen.setdefault(c, []).append((u, v))
            for c, vs in list(seen.items())[:12]:
                problems.append(f"   {c}: {len(vs)} e.g. {vs[:2]}")
            problems.append("   row " + repr(dict(zip(cols, ra[0])))[:900] if ra else "")
            problems.append("   sql " + repr(dict(zip(cols, rb[0])))[:900] if rb else "")
    state = "ok   " if not problems else "FAIL "
    print(f"{state} {entry.name:<34} {len(rows):>8} rows spark {t1 - t0:6.1f}s duckdb {t2 - t1:6.1f}s")
    for p in problems:
        if p:
            print("      ", p)
    return not problems


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--prefix", default="")
    ap.add_argument("--module", default="")
    args = ap.parse_args()
    import duckdb

    from tidemark.queries.registry import load_all
    from tidemark.session import build_session

    entries = load_all()
    names = [n for n in args.only.split(",") if n] or [
        n for n in entries if n.startswith(args.prefix) and entries[n].run.__module__.endswith(args.module)]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = []
    for n in names:
        try:
            if not compare(spark, con, entries[n], args.sf):
                bad.append(n)
        except Exception:
            bad.append(n)
            print("ERROR", n)
            print("\n".join(traceback.format_exc().splitlines()[-4:])[:900])
        sys.stdout.flush()
    print(f"{len(names) - len(bad)}/{len(names)} passed; failing: {bad}")


if __name__ == "__main__":
    main()
