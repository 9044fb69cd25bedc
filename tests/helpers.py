"""Comparison of queries with DuckDB SQL."""

import os


def oracle_rows(sf_dir, sql):
    """Rows of DuckDB SQL over the driver tables, as dicts."""
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def plain(rows):
    """Rows as a sorted list of tuples of (name, value), floats rounded."""

    def value(v):
        return round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v

    return sorted((tuple((k, value(r[k])) for k in sorted(r)) for r in rows), key=str)


def check_query(spark, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    assert plain([r.asDict() for r in frame.collect()]) == plain(oracle_rows(sf_dir, sql))
