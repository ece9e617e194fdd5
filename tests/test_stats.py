import itertools
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.functions import probability as P
from basketry.plans import gates, rfm, stats

HOME = "United Kingdom"


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    n = 12
    data = pd.DataFrame({
        "customer_id": [str(i) for i in range(n)],
        "primary_country": [HOME] * 7 + ["France"] * 5,
        "recency_days": rng.integers(1, 200, n), "frequency_orders": [1, 2, 3, 1, 4, 1, 2, 6, 1, 2, 3, 1],
        "monetary_value_gbp": np.round(rng.gamma(2, 100, n), 2), "average_order_value_gbp": np.round(rng.gamma(2, 40, n), 2),
        "active_span_days": rng.integers(0, 300, n), "units_purchased": rng.integers(1, 90, n),
        "distinct_products": rng.integers(1, 9, n),
    })
    return data, spark.createDataFrame(data)


@pytest.fixture(scope="module")
def orders(spark):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({
        "invoice_no": [f"i{i}" for i in range(20)], "country": [HOME] * 12 + ["Spain"] * 8,
        "order_value_gbp": np.round(rng.gamma(2, 60, 20), 0),
    })
    return data, spark.createDataFrame(data)


def test_spearman_equals_rank_correlation(people):
    data, df = people
    want = data[rfm.MEASURES].corr(method="spearman")
    pairs = stats.spearman_pairs(df, "customer_id", rfm.MEASURES)
    got = pairs.collect()
    assert len(got) == 21
    for a, b, rho in got:
        assert rho == pytest.approx(want.loc[a, b], abs=1e-12)
    matrix = stats.correlation_matrix(pairs, rfm.MEASURES).toPandas().set_index("feature")
    np.testing.assert_allclose(matrix.loc[rfm.MEASURES, rfm.MEASURES], want, atol=1e-12)


def u_by_definition(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_mann_whitney_statistic(orders):
    data, df = orders
    row = stats.mann_whitney(df, "order_value_gbp", F.col("country") == HOME).first()
    a, b = data[data.country == HOME].order_value_gbp, data[data.country != HOME].order_value_gbp
    assert row["u_statistic"] == u_by_definition(a, b)
    assert (row["n_group_1"], row["n_group_2"]) == (12, 8)
    assert row["rank_biserial"] == pytest.approx(2 * row["u_statistic"] / 96 - 1)
    sizes = data.order_value_gbp.value_counts()
    assert row["tie_term"] == float((sizes**3 - sizes).sum())


def plain_tail(u, n1, n2):
    """Counts of every U by the usual recursion, then the sum."""
    counts = {(0, m): [1] for m in range(n2 + 1)} | {(k, 0): [1] for k in range(n1 + 1)}
    for k in range(1, n1 + 1):
        for m in range(1, n2 + 1):
            one, other = counts[k, m - 1], [0] * m + counts[k - 1, m]
            size = k * m + 1
            counts[k, m] = [(one[i] if i < len(one) else 0) + (other[i] if i < len(other) else 0) for i in range(size)]
    last = int(min(u, n1 * n2 - u))
    return min(1.0, 2.0 * sum(counts[n1, n2][: last + 1]) / math.comb(n1 + n2, n1))


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 9), (2, 7), (3, 3), (4, 11), (5, 6), (7, 12), (8, 9), (8, 20), (10, 10)])
def test_exact_p_equals_the_plain_recursion(n1, n2):
    for u in range(n1 * n2 + 1):
        assert P._mann_whitney_exact(u, n1, n2) == pytest.approx(plain_tail(u, n1, n2), rel=1e-14)
        assert P._mann_whitney_exact(u, n2, n1) == P._mann_whitney_exact(u, n1, n2)


def test_exact_p_against_a_very_large_group():
    """8 against 10^8, in bounded memory, next to the normal form."""
    tracemalloc.start()
    small, large = 8, 10**8
    for share in (0.05, 0.3, 0.5):
        u = share * small * large
        exact = P.mann_whitney_p(u, small, large, 0.0)
        assert exact == pytest.approx(P.mann_whitney_p(u, small, large, 0.0, "normal"), abs=0.02)
    assert tracemalloc.get_traced_memory()[1] < 100 * 2**20
    tracemalloc.stop()
    assert P.mann_whitney_p(0, small, large, 0.0) == pytest.approx(2 / math.comb(small + large, small))


def test_exact_p_by_enumeration():
    values = [1.0, 2.5, 3.0, 4.0, 7.0, 9.0, 11.0]
    a = [2.5, 9.0, 11.0]
    observed = u_by_definition(a, [v for v in values if v not in a])
    every = []
    for pick in itertools.combinations(values, 3):
        every.append(u_by_definition(pick, [v for v in values if v not in pick]))
    top = max(observed, 12 - observed)
    want = min(1.0, 2 * sum(u >= top for u in every) / len(every))
    assert P.mann_whitney_p(observed, 3, 4, 0.0) == pytest.approx(want)


def test_normal_branch_and_published_values():
    assert P.chi_square_one_df(0.107383) == pytest.approx(0.743143, abs=1e-6)
    assert 2 * 6350192 / (4255 * 1623) - 1 == pytest.approx(0.83907, abs=1e-5)
    mid = P.mann_whitney_p(200.0, 20, 20, 0.0)
    assert mid == pytest.approx(1.0, abs=0.02)
    assert P.mann_whitney_p(0.0, 20, 20, 0.0) < 1e-6


def test_student_t_closed_forms():
    for t in (0.3, 1.0, 2.5, 12.0):
        assert P.student_t_two_sided(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-10)
        assert P.student_t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)
    assert P.spearman_p(1.0, 30) == 0.0
    assert P.spearman_p(0.0, 30) == pytest.approx(1.0)


def test_contingency_and_chi_square(people):
    data, df = people
    table = stats.contingency(df, HOME)
    rows = {r["geography"]: (r["one_time_customers"], r["repeat_customers"]) for r in table.collect()}
    repeat = data.frequency_orders >= 2
    assert rows[HOME] == (int((~repeat[:7]).sum()), int(repeat[:7].sum()))
    o = np.array([rows[HOME], rows["International"]], dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    row = stats.chi_square(table).first()
    assert row["chi_square"] == pytest.approx(((o - e) ** 2 / e).sum())
    assert row["cramers_v"] == pytest.approx(math.sqrt(((o - e) ** 2 / e).sum() / 12))
    only_home = stats.contingency(df.where(F.col("primary_country") == HOME), HOME)
    assert {r["geography"] for r in only_home.collect()} == {HOME, "International"}


def test_all_tests(people, orders):
    stats.check_inputs(people[1], orders[1])
    tests = stats.hypothesis_tests(people[1], orders[1], HOME).cache()
    rows = tests.collect()
    assert len(rows) == 24 and len(tests.columns) == 21
    assert sum(r["family"] == stats.GROUP_TESTS for r in rows) == 3
    assert all(0 <= r["raw_p_value"] <= r["adjusted_p_value"] <= 1 for r in rows)
    summary = stats.statistical_summary(tests).first()
    assert summary["correlations"] == 21 and summary["tests"] == 24 and summary["customers"] == 12
    effects = [abs(r["effect_size"]) for r in summary["strongest_correlations"]]
    assert len(effects) == 5 and effects == sorted(effects, reverse=True) and len(summary["group_tests"]) == 3
    assert gates.all_passed(gates.stat_gates(people[1], orders[1], 12))


def test_missing_values_are_refused(people, orders):
    holed = people[1].withColumn("recency_days", F.when(F.col("customer_id") != "3", F.col("recency_days")))
    with pytest.raises(ValueError, match="missing values"):
        stats.check_inputs(holed, orders[1])
