"""Compare a query's rows with its SQL in DuckDB, as sets of rows by column name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


def same_rows(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    a, b = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)
