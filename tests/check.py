"""Run queries against their SQL oracle in DuckDB: ``python tests/check.py [sf] [name-part ...]``."""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str):
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    done = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    compare.oracle_seconds = time.time() - done
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows != {len(want)}; extra {str(extra)[:300]} missing {str(lack)[:300]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {str(bad[0])[:600]}", len(got)
    return None, len(got)


def session():
    from tempfile import mkdtemp
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", mkdtemp(prefix="keepsake-check-"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry
    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = [n for n in entry.queries() if not argv[1:] or any(n.startswith(p) or p in n for p in argv[1:])]
    spark, con, failed = session(), duck(sf_dir), []
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                note, n = None, df.count()
                kind = "rows-only"
            else:
                note, n = compare(df, con, sql)
                kind = f"(oracle {compare.oracle_seconds:.1f}s)"
        except Exception as error:  # report and go on
            note, n, kind = f"{type(error).__name__}: {str(error)[:700]}", -1, "error"
        if note:
            failed.append(name)
        print(f"{'FAIL' if note else 'ok  '} {name:40s} {n:8d} rows {time.time() - start:6.1f}s {kind} {note or ''}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
