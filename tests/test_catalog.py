import duckdb
import numpy as np
import pandas as pd
import pytest

from tilewright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (not isinstance(v, (list, tuple, dict, np.ndarray)) and pd.isna(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return float(v) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(frame):
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_oracle(spark, oracle, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), oracle.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["resume_completed", "resume_remaining", "resume_levels_completed"])
def test_lists_of_tiles_are_not_broadcast(spark, name):
    assert "Broadcast" not in final_plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["resume_completed", "resume_remaining", "resume_levels_completed", "tile_paths_parsed", "object_keys", "packfile_entries", "plan_tiles_google_256_1"])
def test_tiles_of_a_small_file_are_made_by_many_tasks(spark, name):
    plan = final_plan(catalog.QUERIES[name](spark, SF))
    assert "hashpartitioning(image_id" in plan and "REPARTITION_BY_NUM" in plan


def test_plan_hashes_differ(spark):
    got = catalog.QUERIES["plan_hashes"](spark, SF).toPandas()
    assert got.plan_hash.nunique() == len(got) and got.plan_hash.str.fullmatch("[0-9a-f]{64}").all()


def test_plan_hashes_are_those_of_jobs(spark):
    from tilewright.plans.job import PyramidJob

    row = catalog.images(spark, SF, "google", overlap=1, centre=True).orderBy("image_id").first()
    got = catalog.QUERIES["plan_hashes"](spark, SF).where(f"image_id = {row.image_id}").first()
    assert got.plan_hash == PyramidJob(row.width, row.height, 256, 1, "google", True).plan_hash(spark)


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
