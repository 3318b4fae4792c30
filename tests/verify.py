"""Compare queries with their SQL in DuckDB: python tests/verify.py [SF_DIR] [NAME...]"""

import glob
import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def kind(t):
    t = str(t)
    return "string" if "string" in t else t


def digest(table):
    names = sorted(table.column_names)
    rows = sorted(repr(tuple(canon(r[n]) for n in names)) for r in table.to_pylist())
    return names, len(rows), hashlib.md5("\n".join(rows).encode()).hexdigest(), rows


def run(sf, names=()):
    import duckdb

    import __spark_entry__ as e
    from corpusloom.session import local_session

    spark = local_session()
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    q, o = e.queries(), e.oracle_sql()
    bad = []
    for name, f in q.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            ours = f(spark, sf).toArrow()
            a = digest(ours)
            took = time.time() - t
            if name not in o:
                print(f"rows {name} {a[1]} {took:.1f}s", flush=True)
                continue
            theirs = con.sql(o[name]).to_arrow_table()
            b = digest(theirs)
            kinds = [(n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in set(a[0]) & set(b[0]) if kind(ours.schema.field(n).type) != kind(theirs.schema.field(n).type)]
            if kinds:
                print("types", name, kinds, flush=True)
        except Exception as x:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name} {str(x)[:1500]}", flush=True)
            continue
        ok = a[:3] == b[:3]
        if not ok:
            bad.append(name)
        print(("ok  " if ok else "DIFF"), name, a[1], b[1], f"{took:.1f}s", flush=True)
        if not ok:
            print("  ", a[0], b[0], [x for x in a[3] if x not in set(b[3])][:3], [x for x in b[3] if x not in set(a[3])][:3], flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(run(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
