"""The driver contract and a few registered queries against their SQL on the smallest tables."""

import inspect

import duckdb
import pytest

import __spark_entry__ as entry
from basketspark.catalog import segments, spending
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_the_profile_columns(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 21 and df.count() > 0


@pytest.mark.parametrize(
    "name", ["match_cancellations", "drop_unmatched_returns_prod_descr", "monthly_stats", "box_stats_sale", "frequent_items"]
)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == ""


class Called(Exception):
    pass


@pytest.mark.parametrize(
    "name, module, operator, want",
    [
        ("xmeans", segments.partition, "xmeans", {"k_max": 100}),
        ("elbow", segments.partition, "elbow", {"ks": range(2, 31), "n_init": 10, "max_iter": 100}),
        ("feature_search", segments.partition, "feature_search", {"r": 3, "ks": (3, 4, 5, 6), "n_init": 10, "max_iter": 1000}),
        ("kmeans_restarts", segments.partition, "kmeans", {"k": 5, "n_init": 100, "max_iter": 1000}),
        ("fuzzy_cmeans_farthest_start", segments.partition, "fuzzy_cmeans", {"iterations": 100}),
        ("gaussian_mixture", segments.partition, "gaussian_mixture", {"k": 5, "max_iter": 100}),
        ("gaussian_mixture_components", segments.partition, "gaussian_mixture", {"k": 5, "max_iter": 100}),
        ("evolved_centres", segments.partition, "evolve_centres", {"k": 4, "population": 500, "generations": 2000}),
        ("spending_classes_restarts", spending.labels, "spending_classes", {"n_init": 1000, "max_iter": 1000}),
    ],
)
def test_searches_are_registered_whole(spark, monkeypatch, name, module, operator, want):
    signature, seen = inspect.signature(getattr(module, operator)), {}

    def stop(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        seen.update(bound.arguments, **bound.arguments.get("kmeans_options", {}))
        raise Called

    monkeypatch.setattr(module, operator, stop)
    with pytest.raises(Called):
        entry.queries()[name](spark, SF)
    assert {k: seen[k] for k in want} == want
    if name == "feature_search":
        assert len(seen["cols"]) == 15 and seen["df"].count() > 0
        assert not seen["df"].where(" or ".join(f"{c} is null" for c in seen["cols"])).count()


def test_grids_are_registered_whole():
    assert (len(segments.DBSCAN_EPS), segments.DBSCAN_EPS[0], segments.DBSCAN_EPS[-1]) == (90, 0.01, 0.099)
    assert segments.DBSCAN_MIN_PTS == [2, 3, 4, 5, 6, 7, 8, 9]
    assert spending.TREE_GRID["maxDepth"] == list(range(10, 31)) and spending.FOREST_GRID["maxDepth"] == list(range(2, 20))
    assert spending.FOREST_GRID["minInstancesPerNode"] == list(range(1, 10)) and len(spending.CLASS_WEIGHTS) == 3
