"""Run registered queries and their SQL side by side: ``python tests/oracle.py [sf] [name ...]``."""

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


TIMES = [0.0, 0.0]


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return "0.0" if value == 0 else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(df, con, sql):
    cols = sorted(df.columns)
    t = time.time()
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    TIMES[0] = time.time() - t
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    TIMES[1] = time.time() - t
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}", sum(ours.values())
    pos = [names.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[p]) for p in pos) for r in rows)
    if ours == theirs:
        return None, sum(ours.values())
    a, b = list((ours - theirs).items()), list((theirs - ours).items())
    text = f"spark {sum(ours.values())} rows, sql {sum(theirs.values())}; only spark {len(a)}, only sql {len(b)}; {cols}"
    for x in sorted(a)[:3]:
        text += f"\n   spark {str(x)[:600]}"
    for x in sorted(b)[:3]:
        text += f"\n   sql   {str(x)[:600]}"
    return text, sum(ours.values())


if __name__ == "__main__":
    import __spark_entry__ as entry
    from corpusradar.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem, rows = compare(queries[name](spark, folder), con, oracles[name])
            else:
                problem, rows = None, len(queries[name](spark, folder).collect())
        except Exception as e:
            problem, rows = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += problem is not None
        flag = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        if problem or rows == 0 or names or time.time() - t > 12:
            print(f"{flag} {name} rows={rows} {time.time() - t:.1f}s (collect {TIMES[0]:.1f} sql {TIMES[1]:.1f}) {problem or ''}", flush=True)
    print(f"{len(queries)} queries, {len(oracles)} with SQL, {bad} failing")
