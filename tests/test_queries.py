"""Every registered query against its SQL counterpart, and plan guards."""

import re

import pytest

from basketry.operators import dedup
from basketry.plans import star
from basketry.sources import sample_tables
from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES, Tables, doubles

# Their SQL lists the month columns of the larger samples.
WIDE = ("cohort_counts_wide", "cohort_retention_wide")


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(tables, con, name):
    df = doubles(QUERIES[name](tables))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    guard_windows(plan)
    rows = df.collect()
    assert rows or name in {"missing_values"}
    if name not in WIDE:
        assert difference(df, rows, con.execute(ORACLE[name])) is None


@pytest.mark.parametrize("name", WIDE)
def test_wide_query(spark, name):
    folder = "/root/testdata/sf0.01"
    df = doubles(QUERIES[name](Tables(spark, folder)))
    assert difference(df, df.collect(), connect(folder).execute(ORACLE[name])) is None


def test_order_summary_hashes_all_lines(tables):
    """The widest aggregate, over the lines themselves, is a hash aggregate."""
    plan = QUERIES["order_summary"](tables)._jdf.queryExecution().executedPlan().toString()
    aggregates = [line for line in plan.split("\n") if re.search(r"(Hash|Sort)Aggregate", line)]
    assert "HashAggregate" in aggregates[-1] and "stock_code" in aggregates[-1]


def test_raw_profile_shuffles_lines_once(tables):
    """All identity columns appear as the keys of one exchange."""
    plan = QUERIES["raw_profile"](tables)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "description" in line and "country" in line]
    assert len(wide) == 1


def test_metrics_keep_customers_off_the_driver(tables, monkeypatch):
    """Rows per cluster and per label pair come back, at most 16 at once; no customer rows."""
    frame, sizes = type(tables.rfm()), []
    collect = frame.collect

    def counted(self):
        rows = collect(self)
        if {"customer_id", "a"} & set(self.columns):
            sizes.append(len(rows))
        return rows

    def refused(self):
        raise AssertionError("customers come to the driver")

    monkeypatch.setattr(frame, "toPandas", refused)
    monkeypatch.setattr(frame, "collect", counted)
    got = QUERIES["k_metrics"](tables)
    monkeypatch.undo()
    assert sizes and max(sizes) <= 16
    assert [tuple(r)[1:] for r in got.collect()] == [(4, True, True, True, True)]


def guard_windows(plan: str) -> None:
    """Windows over one partition may only order bounded tables."""
    bounded = ("_part#", "year_month#", "median_", "cluster_id#", "_w0#", "sum(_w0")
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line) and "SinglePartition" in "\n".join(lines[i : i + 4]):
            assert any(word in line for word in bounded), line


def _shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_canonical_lines_are_not_shuffled_again_for_copies(spark, folder):
    """Lines joined with their orders lie by order, and copies share one."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = sample_tables.transaction_lines(spark, folder, [sample_tables.ORDER_KEY])
        unique = dedup.drop_exact_copies(lines, [sample_tables.ORDER_KEY])
        assert _shuffles(unique) == _shuffles(lines)
        plain = dedup.drop_exact_copies(sample_tables.transaction_lines(spark, folder))
        assert unique.columns == plain.columns and unique.exceptAll(plain).isEmpty() and plain.exceptAll(unique).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_order_summary_shuffles_twice(tables):
    assert _shuffles(QUERIES["order_summary"](tables)) == 2


def test_small_keys_go_into_the_large_look_ups(tables):
    """The country's key is found first, so that no name is shuffled with the lines."""
    plan = star.with_keys(tables.sales(), tables.dims())._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"AS _dim_id#\d+, (\w+_key)#", plan)
    assert keys == ["country_key", "product_key", "customer_key"]
