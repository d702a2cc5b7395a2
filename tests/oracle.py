"""Holding a query against its SQL, as the driver does: columns by name, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(None if v != v else v for v in row) for row in df.itertuples(index=False)), key=repr)


def assert_same(spark, con, sf, query, sql):
    got, want = plain(query(spark, sf).toPandas()), plain(con.execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
