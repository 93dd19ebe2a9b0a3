"""Holds a query against its SQL on the small tables."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cells, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in cells)


def same(spark, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = query(spark, SF)
    want = db.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(want.fetchall(), columns)
