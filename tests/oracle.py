"""Compare a query with its SQL in DuckDB, by values and whatever the order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return repr([plain(x) for x in v])
    if v is None or v != v:
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df[names].itertuples(index=False))


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(query(spark, sf_dir).toPandas()) == rows(con.execute(sql).df())
