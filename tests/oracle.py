"""Compare a query with its SQL in DuckDB, on all rows."""

import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return str(v)


def table(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(tuple(normal(r[i]) for i in at) for r in rows)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    found = query(spark, sf_dir)
    names = sorted(found.columns)
    mine = table([tuple(r) for r in found.collect()], found.columns, names)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert mine == table(result.fetchall(), columns, names)
    return mine
