"""Comparison of query results with DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    return sorted([tuple("~" if v is None or v != v else round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in rows], key=str)


def from_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, [dict(zip(names, r)) for r in got.fetchall()]


def same(df, sql, sf_dir):
    rows = [r.asDict() for r in df.collect()]
    names, other = from_duckdb(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert plain(rows, columns) == plain(other, columns)
