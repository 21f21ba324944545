"""Registered queries against their SQL oracles, and the driver contract."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as driver
from tools.check import TABLES, canonical

# One of each family; tools/check.py runs them all.
SAMPLE = [
    "nearest_on_grid", "extract_counters", "nearest_all_events", "training_curves", "domain_split", "session_split_even", "matched_by_stem",
    "session_folders", "temperature_condition", "decoupled_drawn", "augmented_windows", "scored_pairs", "correlation_verdict", "pair_manifest",
    "objective_terms", "written_conditions", "paired_samples", "translated_conditions", "shortcut_check", "session_pairs",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, con, name):
    df = driver.queries()[name](spark, SF)
    cur = con.execute(driver.oracle_sql()[name])
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == want


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns == ["stem", "l1", "rmse", "psnr", "ssim"]


def test_training_curves_reads_iterations_beyond_five_digits(spark, con, tmp_path):
    con.sql(f"COPY (SELECT * REPLACE (o_orderkey + 60 * 150000 AS o_orderkey) FROM '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    cur = own.execute(driver.oracle_sql()["training_curves"])
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    df = driver.queries()["training_curves"](spark, str(tmp_path))
    assert canonical([tuple(r) for r in df.collect()], df.columns) == want
