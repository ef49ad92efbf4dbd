"""Registered queries against their SQL oracles, in DuckDB on the same Parquet tables.

By default one query of each kind runs; SURVLOOM_ALL_QUERIES=1 runs every one.
"""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = """csv_round_trip diagonal_union stack_features assign_folds holdout_split weight_graded
    scale_target_by_event encode_ordinal encode_aggregate encode_target_oof quantile_bins
    km_curve nelson_aalen_curve asof_curve_lookup fold_scores breslow_baseline
    cox_newton_terms cox_fit_weighted pipeline_reload concordance_counts_lines hazard_stage_means oof_ridge multi_seed objective_tweedie mixture_curve""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(rows):
    """Rows in one order; a missing number is None in both engines."""
    clean = [tuple(None if v is None or v != v else v for v in row) for row in rows]
    return sorted(clean, key=lambda row: [(v is None, str(v)) for v in row])


def names():
    return list(contract.oracle_sql()) if os.environ.get("SURVLOOM_ALL_QUERIES") else QUICK


@pytest.mark.parametrize("name", names())
def test_against_sql(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.execute(contract.oracle_sql()[name])
    found = [d[0] for d in want.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = plain([tuple(row[i] for i in order) for row in want.fetchall()])
    assert plain([tuple(r) for r in got.select(*[F.col(f"`{c}`") for c in columns]).collect()]) == expected


def test_entry(spark):
    assert contract.entry(spark).count() == 1


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["event_probability", "base_experiment", "stack_experiment"])
def test_whole_jobs_cover_all_rows(spark, name):
    rows = contract.queries()[name](spark, FOLDER)
    ids = rows.select("ID").distinct().count()
    assert rows.count() == ids and ids in (1350, 1500)


def test_pair_counts_survive_many_partitions_and_small_groups(spark):
    from survloom.operators.concordance import concordance_counts
    from survloom.sources.frames import survival_frame

    frame = survival_frame(spark, FOLDER)
    one, many = (
        concordance_counts(frame, "efs_time", "efs", "pred", keys=["stratum"], group_rows=g)
        .orderBy("stratum")
        .collect()
        for g in (1 << 20, 200)
    )
    assert one == many
