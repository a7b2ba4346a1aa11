import os

import duckdb
import pandas as pd

from tessella.llm import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def larger(sf: str) -> str:
    """The next larger generated tables."""
    return sf.replace("sf0.001", "sf0.01")


def same_as_sql(spark, sf, name):
    """The registered query and its SQL give the same rows."""
    con = duckdb.connect()
    for t in TABLES.split():
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    whole = lambda df: df.assign(**{c: df[c].astype("Int64") for c in columns if str(df[c].dtype) == "float64" and (df[c].dropna() % 1 == 0).all()})
    assert rows(whole(got)) == rows(whole(want))
