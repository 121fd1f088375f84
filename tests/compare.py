"""Runs a registered query and its SQL on the same folder and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def same_rows(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    df = query(spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(_plain(dict(zip(names, r, strict=True))[n]) for n in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[n]) for n in order) for r in df.collect()), key=repr)
    assert got == want and (got or sql.count("HAVING"))
