"""A query and its SQL, side by side."""

import math
import os

import duckdb

from envlattice.llm import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sql, sf_dir):
    with duckdb.connect() as c:
        for t in TABLES.split():
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        r = c.execute(sql)
        names = [d[0] for d in r.description]
        return names, r.fetchall()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(clean(r[i]) for i in order) for r in data)


def assert_same(spark, name, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    names, data = duck(queries.oracle_sql()[name], sf_dir)
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, data)
    assert len(mine) == len(theirs)
    assert mine == theirs
