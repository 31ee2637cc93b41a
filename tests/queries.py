"""Running a registered query beside its SQL."""

from collections import Counter
from pathlib import Path

import duckdb

from tools.compare import norm

SF_DIR = Path("/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def check(spark, con, query, sql):
    df = query(spark, str(SF_DIR))
    assert len(set(df.columns)) == len(df.columns)
    got = Counter(tuple(norm(row[c]) for c in sorted(df.columns)) for row in df.collect())
    if sql is None:
        return got
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = Counter(tuple(norm(row[i]) for i in order) for row in result.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return got
