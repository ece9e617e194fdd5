import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.plans import cohort, gates, rfm

DAY = dt.date(2022, 1, 31)


def made_sales():
    """Customer n of 7 buys n times, every 40 n days before the last day, for n * 10 + order number."""
    rows = []
    for n in range(1, 8):
        for order in range(n):
            day = DAY - dt.timedelta(days=(n - 1) + 40 * n * order)
            rows.append((f"cust-{n}", f"inv-{n}-{order}", day, f"item-{order % 3}", 2 * n + order, 10.0 * n + order))
    return rows


SALES = made_sales()


@pytest.fixture
def sales(spark):
    df = spark.createDataFrame(SALES, "customer_id string, invoice_no string, d date, stock_code string, quantity int, r double")
    return df.select(
        "customer_id", "invoice_no", F.to_timestamp("d").alias("invoice_date"), "stock_code", "quantity",
        F.col("r").cast("decimal(18,4)").alias("line_revenue"), F.lit("Utopia").alias("country"),
        F.lit(True).alias("has_customer_id"), F.lit(True).alias("is_completed_sale"),
        F.lit("completed_sale").alias("transaction_type"),
    )


def test_rfm_table(sales):
    table = {r["customer_id"]: r for r in rfm.rfm_table(rfm.identified_sales(sales)).collect()}
    assert len(table) == 7
    for n in range(1, 8):
        own, row = [s for s in SALES if s[0] == f"cust-{n}"], table[f"cust-{n}"]
        value = sum(s[5] for s in own)
        days = [s[2] for s in own]
        assert row["recency_days"] == (DAY - max(days)).days + 1 == n
        assert row["frequency_orders"] == n and row["monetary_value_gbp"] == value
        assert row["active_span_days"] == (max(days) - min(days)).days
        assert row["average_order_value_gbp"] == pytest.approx(value / n)
        assert row["units_purchased"] == sum(s[4] for s in own) and row["distinct_products"] == min(n, 3)
        assert row["rfm_code"] == f"{row['r_score']}{row['f_score']}{row['m_score']}"
    assert table["cust-1"]["r_score"] == 5 == table["cust-7"]["f_score"] and table["cust-1"]["m_score"] == 1


def test_identified_sales_uses_the_flags_that_exist(sales):
    some = sales.withColumn("is_completed_sale", F.col("customer_id") != "cust-7")
    assert rfm.identified_sales(some).count() == 21
    assert rfm.identified_sales(some.drop("is_completed_sale")).count() == 28
    with pytest.raises(ValueError, match="No identified"):
        rfm.require_identified_sales(sales.limit(0))
    with pytest.raises(ValueError, match="stock_code"):
        rfm.identified_sales(sales.drop("stock_code"))


def segment_by_rule(r, f, m, orders):
    """The ordered rules, stated once more."""
    if orders >= 2 and min(r, f, m) >= 4:
        return "Champions"
    if orders >= 2 and r >= 3 and f >= 4 and m >= 3:
        return "Loyal Customers"
    if orders >= 2 and r >= 4 and f in (2, 3) and m >= 2:
        return "Potential Loyalists"
    if orders == 1 and r >= 4:
        return "New Customers"
    if orders >= 2 and r <= 2 and min(f, m) >= 4:
        return "Cannot Lose Them"
    if r <= 2 and max(f, m) >= 3:
        return "At Risk"
    return "Hibernating" if r <= 2 else "Need Attention"


def test_segment_rules_for_every_score(spark):
    scores = range(1, 6)
    rows = [(segment_by_rule(r, f, m, n), r, f, m, n) for r in scores for f in scores for m in scores for n in (1, 2)]
    df = spark.createDataFrame(rows, "want string, r_score int, f_score int, m_score int, frequency_orders int")
    assert rfm.assign_segments(df).where("want <> segment").count() == 0
    assert {r[0] for r in rows} == set(rfm.SEGMENT_NAMES)


def test_segment_summary_keeps_empty_segments(sales):
    table = rfm.rfm_table(sales)
    rows = rfm.segment_summary(table).collect()
    assert [r["segment"] for r in rows] == rfm.SEGMENT_NAMES
    assert sum(r["customer_count"] for r in rows) == 7
    assert sum(r["customer_share_pct"] for r in rows) == pytest.approx(100)
    assert sum(r["revenue_share_pct"] for r in rows) == pytest.approx(100)


def months_after(first, day):
    return (day.year - first.year) * 12 + day.month - first.month


def test_cohorts(sales):
    long = cohort.cohort_long(sales)
    starts = {c: min(s[2] for s in SALES if s[0] == c).replace(day=1) for c in {s[0] for s in SALES}}
    active = {}
    for customer, _, day, *_ in SALES:
        active.setdefault((str(starts[customer]), months_after(starts[customer], day)), set()).add(customer)
    cells = {(str(r["acquisition_month"]), r["cohort_month_index"]): r for r in long.collect()}
    for (month, index), r in cells.items():
        assert r["active_customers"] == len(active.get((month, index), ()))
        assert r["cohort_size"] == sum(str(s) == month for s in starts.values())
        assert index > 0 or r["retention_pct"] == 100.0
    for start in set(starts.values()):
        assert max(i for m, i in cells if m == str(start)) == months_after(start, DAY)
    # The data reach the last day of their last month.
    assert long.where("is_partial_period").count() == 0
    cut = cohort.cohort_long(sales.where("invoice_date < '2022-01-31'"))
    assert {str(r["purchase_month"]) for r in cut.where("is_partial_period").collect()} == {"2022-01-01"}
    wide = {r["acquisition_month"]: r for r in cohort.widen(long, "active_customers").collect()}
    newest = max(starts.values())
    assert wide[str(newest)[:7]]["month_0"] >= 1 and wide[str(newest)[:7]]["month_1"] is None
    meta = cohort.cohort_metadata(long).first()
    assert meta["max_cohort_month_index"] == max(i for _, i in cells)


def test_bitmaps_over_many_years(spark):
    """Months in several words, a customer with many lines in one month, gaps, and months without any buyer."""
    rng = random.Random(5)
    months = sorted(rng.sample(range(240), 40))
    active = {f"c{i}": sorted(rng.sample(months, rng.randint(1, 9))) for i in range(60)}
    rows = [(c, dt.datetime(1990 + m // 12, m % 12 + 1, rng.randint(1, 28))) for c, own in active.items() for m in own for _ in range(3)]
    rows += [("c0", dt.datetime(1990 + active["c0"][0] // 12, active["c0"][0] % 12 + 1, 3))] * 300
    lines = spark.createDataFrame(rows, "customer_id string, invoice_date timestamp").repartition(5)
    base, last = min(m for own in active.values() for m in own), max(m for own in active.values() for m in own)

    def place(day):
        return (day.year - 1990) * 12 + day.month - 1

    cells = {(place(r["acquisition_month"]), place(r["purchase_month"])): r for r in cohort.cohort_long(lines).collect()}
    firsts = {own[0] for own in active.values()}
    assert set(cells) == {(f, m) for f in firsts for m in range(f, last + 1)}
    for (first, month), r in cells.items():
        assert r["active_customers"] == sum(own[0] == first and month in own for own in active.values())
        assert r["cohort_size"] == sum(own[0] == first for own in active.values())
    flow = {place(r["month_start"]): r for r in cohort.customer_flow(lines).collect()}
    assert set(flow) == set(range(base, last + 1))
    for m, r in flow.items():
        now, before = ({c for c, own in active.items() if i in own} for i in (m, m - 1))
        new = {c for c, own in active.items() if own[0] == m}
        assert r["active_customers"] == len(now) and r["new_customers"] == len(new)
        assert r["retained_customers"] == len(now & before) and r["lapsed_customers"] == len(before - now)
        assert r["reactivated_customers"] == len(now - before - new)


def test_cohorts_of_no_lines(sales):
    assert cohort.cohort_long(sales.limit(0)).count() == 0 and cohort.customer_flow(sales.limit(0)).count() == 0


def test_lines_are_shuffled_once_for_cohorts(sales):
    found = cohort.histories(sales)
    plan = cohort.customer_bitmaps(sales, found.base, found.base + found.last)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(customer_id") == 1 and plan.count("partial_bit_or") >= 1


TOTAL = sum(s[5] for s in SALES)


def test_customer_gates(sales):
    table = rfm.rfm_table(sales)
    checks = gates.customer_gates(table, rfm.segment_summary(table), cohort.cohort_long(sales), 7, TOTAL)
    assert gates.all_passed(checks) and checks.count() == 6
    wrong = gates.customer_gates(table, rfm.segment_summary(table), cohort.cohort_long(sales), 6, TOTAL + 0.5)
    assert {r["gate"] for r in wrong.where("NOT passed").collect()} == {"customer_count", "monetary_value_reconciliation"}


def test_summary_row(sales):
    row = rfm.customer_summary_stats(sales, rfm.rfm_table(sales)).first()
    assert row["snapshot_date"] == DAY + dt.timedelta(days=1) and row["total_monetary_value_gbp"] == TOTAL
