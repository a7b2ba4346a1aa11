"""Every registered query against its SQL twin in DuckDB."""

import hashlib

import duckdb
import pandas as pd
import pytest

from tessella.operators import artifacts
from tessella.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: "" if v is None or (not isinstance(v, float) and pd.isna(v)) else repr(round(v, 9)) if isinstance(v, float) else str(v)
    columns = sorted(df.columns)
    return sorted(tuple(map(cell, row)) for row in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    if name == "rank_skip_topk_words" and duck.sql(f"SELECT count(*) FROM ({registry.ORACLES['eligible_words']})").fetchall()[0][0] < 120:
        pytest.skip("too few words at this size")
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


def test_join_predictions_beyond_100000_parts(spark, sf, tmp_path):
    """Row ids of the safe probe reach those of the attack probe there; each row is still joined once."""
    con = duckdb.connect()
    for t, key in (("part", "p_partkey"), ("supplier", None), ("lineitem", "l_partkey")):
        own = f"SELECT * FROM '{sf}/{t}.parquet'"
        more = f" UNION ALL SELECT * REPLACE ({key} + 100000 AS {key}) FROM '{sf}/{t}.parquet'" if key else ""
        con.sql(f"COPY ({own}{more}) TO '{tmp_path}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.sql(registry.ORACLES["join_predictions"]).df()
    assert want.row_id.duplicated().any()
    assert tidy(registry.QUERIES["join_predictions"](spark, str(tmp_path)).toPandas()) == tidy(want)


def test_queries_without_sql(spark, sf):
    drawn = registry.QUERIES["recipe_unique_draws"](spark, sf).collect()
    recipes = [tuple(r.causes.split("|")) for r in drawn]
    assert len(recipes) == len(set(recipes)) == spark.read.parquet(f"{sf}/part.parquet").count()
    assert all(len(set(r)) == 3 for r in recipes)


def test_checksums_of_all_tables(spark, duck, sf):
    """Rows and streams give the digests that DuckDB gives of the same files."""
    want = duck.sql(f"SELECT parse_filename(filename, true), sha256(content), size > {1 << 20} FROM read_blob('{sf}/*.parquet')").fetchall()
    assert sorted(registry.QUERIES["file_checksums"](spark, sf).collect()) == sorted(r[:2] for r in want) and len(want) > 10
    larger = sf.replace("sf0.001", "sf0.01")
    want = duck.sql(f"SELECT parse_filename(filename, true), sha256(content), size > {1 << 20} FROM read_blob('{larger}/*.parquet')").fetchall()
    assert sorted(registry.QUERIES["file_checksums"](spark, larger).collect()) == sorted(r[:2] for r in want)
    assert {r[2] for r in want} == {False, True}


def test_checksums_of_tables_that_are_folders(spark, sf, tmp_path):
    """Each file of a folder has its digest, by a row or by a stream; hidden ones have none."""
    held = {"a.parquet": b"a", "t.parquet/part-0 %20é.parquet": b"x" * 2_000_000, "t.parquet/part-1.parquet": b"y" * 700_000, "t.parquet/part-2.parquet": b"", "t.parquet/day=1/part-3.parquet": b"z" * 1_500_000}
    for name, content in {**held, "t.parquet/_SUCCESS": b"", "t.parquet/.part-1.parquet.crc": b"c"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    want = sorted((name.split(".")[0], hashlib.sha256(content).hexdigest()) for name, content in held.items())
    assert sorted(map(tuple, registry.QUERIES["file_checksums"](spark, str(tmp_path)).collect())) == want
    for row_bytes in (0, 1 << 30):
        found = artifacts.checksums(spark, [f"file://{tmp_path}", str(tmp_path / "a.parquet"), str(tmp_path / "none")], row_bytes).collect()
        assert sorted(r.sha256 for r in found) == sorted(d for _, d in want)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
