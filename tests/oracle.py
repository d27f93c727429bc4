"""Compare queries with their SQL: python -m tests.oracle [sf_dir] [names...]"""

import glob
import os
import sys
import time

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if v != v else repr(round(v, 6) + 0.0)
        return repr(v) if v is not None else None

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is not None, v or "") for v in r)), [columns[i] for i in order]


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want, wanted = rows_of(rel.columns, rel.fetchall())
    if names != wanted:
        return f"columns {names} {wanted}"
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} wanted"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from photoloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, q, sql = local_session(8, 8), connect(sf), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            said = compare(spark, con, sf, q[name], sql[name]) if name in sql else f"rows only: {q[name](spark, sf).count()}"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"\n{'ok ' if not said else 'BAD' if not said.startswith('rows') else 'ok '} {name} {time.time() - t:.1f} s {said}", flush=True)
