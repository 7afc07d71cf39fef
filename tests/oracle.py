"""Compare a query with its SQL in DuckDB: columns by name, rows in any order, floats to six digits."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(values, columns) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


def expected(db, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    cur = db.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows(cur.fetchall(), columns)
