"""SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from itertools import combinations


# Fixed values, stated here a second time so that a wrong one in the library fails.
SEGMENTS = [
    (
        "Champions",
        "R >= 4, F >= 4, M >= 4, and at least 2 completed orders.",
        "Protect with early access, premium service, and referral invitations.",
        "Protect",
    ),
    (
        "Loyal Customers",
        "R >= 3, F >= 4, M >= 3, and at least 2 completed orders.",
        "Use loyalty rewards, replenishment reminders, and cross-sell offers.",
        "Grow",
    ),
    (
        "Potential Loyalists",
        "R >= 4, F between 2 and 3, M >= 2, and at least 2 completed orders.",
        "Nurture with second-next-purchase offers and category recommendations.",
        "Nurture",
    ),
    (
        "New Customers",
        "R >= 4 and exactly 1 completed order.",
        "Send onboarding, product education, and a timely second-order incentive.",
        "Onboard",
    ),
    (
        "Cannot Lose Them",
        "R <= 2, F >= 4, M >= 4, and at least 2 completed orders.",
        "Prioritise personal reactivation and service recovery before discounting.",
        "Recover",
    ),
    (
        "At Risk",
        "R <= 2 and either F >= 3 or M >= 3.",
        "Trigger win-back journeys based on past categories and purchase timing.",
        "Win back",
    ),
    (
        "Hibernating",
        "R <= 2, F <= 2, and M <= 2.",
        "Use low-cost reactivation tests and suppress if engagement stays absent.",
        "Test",
    ),
    (
        "Need Attention",
        "All remaining customers after the ordered rules above.",
        "Monitor behaviour and use light-touch merchandising or survey prompts.",
        "Monitor",
    ),
]
LABELS = {
    1: "High-Value Champions",
    2: "Recent Growth Customers",
    3: "Lapsed Established Customers",
    4: "Dormant Low-Value Customers",
}
ACTIONS_BY_RECENCY = {
    1: "Protect current value with recognition, priority service, and relevant loyalty offers.",
    2: "Nurture the next purchase with timely cross-sell and replenishment prompts.",
    3: "Prioritise profile-based reactivation using known categories before broad discounting.",
    4: "Use low-cost re-engagement tests and suppress outreach if inactivity persists.",
}

HOME = "NATION_0"
SHIFT = 2**55
IDENTITY = [
    "invoice_no", "stock_code", "description", "quantity", "invoice_date", "unit_price",
    "customer_id", "country",
]
IDS = ", ".join(IDENTITY)
LOAD_ORDER = "load_seq, " + ", ".join(f"{c} NULLS FIRST" for c in IDENTITY)

def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def ratio(num: str, den: str, scale: int = 1) -> str:
    top = dbl(num) if scale == 1 else f"{scale}.0::DOUBLE * {dbl(num)}"
    return f"({top}) / NULLIF({dbl(den)}, 0)"


def rounded(num: str, den: str, scale: int = 1, digits: int = 2) -> str:
    """num / den, half up, in exact integer arithmetic."""
    p = 10**digits
    a = f"CAST(CAST({num} AS DECIMAL(28,4)) * 10000 AS HUGEINT) * {scale * p}"
    b = f"CAST(CAST({den} AS DECIMAL(28,4)) * 10000 AS HUGEINT)"
    return (
        f"(CASE WHEN {b} = 0 THEN NULL ELSE {dbl(f'SIGN({a}) * ((2 * ABS({a}) + {b}) // (2 * {b}))')}"
        f" / {p}.0 END)"
    )


TXN = f"""
txn AS MATERIALIZED (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_no,
    'P' || CAST(l_partkey AS VARCHAR) AS stock_code,
    CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE p_name END AS description,
    CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS INTEGER) AS quantity,
    CAST(o_orderdate AS TIMESTAMP) AS invoice_date,
    CASE WHEN l_returnflag = 'A' AND l_tax >= 0.08 THEN CAST(0 AS DECIMAL(18,4))
         ELSE CAST(p_retailprice AS DECIMAL(18,4)) END AS unit_price,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
    n_name AS country,
    CASE WHEN EXTRACT(year FROM o_orderdate) < 1998 THEN 0 ELSE {SHIFT} END::BIGINT + l_linenumber AS load_seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

FLAGS = """
    CAST(quantity * unit_price AS DECIMAL(18,4)) AS line_revenue,
    COALESCE(upper(invoice_no) LIKE 'C%', FALSE) AS is_cancelled,
    COALESCE(upper(invoice_no) LIKE 'C%', FALSE) OR COALESCE(quantity < 0, FALSE) AS is_return,
    COALESCE(NOT COALESCE(upper(invoice_no) LIKE 'C%', FALSE) AND quantity > 0 AND unit_price > 0, FALSE)
      AS is_completed_sale,
    customer_id IS NOT NULL AS has_customer_id"""

KIND = """CASE WHEN is_completed_sale THEN 'completed_sale' WHEN is_return THEN 'return_or_cancellation'
    ELSE 'excluded_non_sale' END AS transaction_type,
    CASE WHEN is_completed_sale OR is_return THEN NULL WHEN invoice_no IS NULL THEN 'missing_invoice'
      WHEN quantity <= 0 THEN 'non_positive_quantity' WHEN unit_price <= 0 THEN 'non_positive_price'
      ELSE 'other_invalid_non_sale' END AS exclusion_reason"""

LINES = f"""{TXN},
uniq AS (SELECT {IDS}, MIN(load_seq) AS load_seq FROM txn GROUP BY {IDS}),
flagged AS (SELECT ROW_NUMBER() OVER (ORDER BY {LOAD_ORDER}) AS transaction_line_id, *, {FLAGS} FROM uniq),
lines AS MATERIALIZED (SELECT *, {KIND},
  CASE WHEN load_seq >= {SHIFT} THEN 'batch_2' ELSE 'batch_1' END AS source_batch,
  strftime(invoice_date, '%Y-%m') AS year_month, EXTRACT(year FROM invoice_date) AS year,
  CAST(date_trunc('month', invoice_date) AS DATE) AS month_start FROM flagged),
sales AS (SELECT * FROM lines WHERE transaction_type = 'completed_sale'),
returns AS (SELECT * FROM lines WHERE transaction_type = 'return_or_cancellation'),
known AS (SELECT * FROM sales WHERE customer_id IS NOT NULL)"""

ORDER_SUMMARY = """
osum AS MATERIALIZED (SELECT invoice_no, MIN(invoice_date) AS invoice_date,
  arg_min(customer_id, transaction_line_id) FILTER (WHERE customer_id IS NOT NULL) AS customer_id,
  arg_min(country, transaction_line_id) FILTER (WHERE country IS NOT NULL) AS country,
  SUM(line_revenue) AS order_value, CAST(SUM(quantity) AS BIGINT) AS units, COUNT(*) AS product_lines,
  COUNT(DISTINCT stock_code) AS distinct_products FROM sales GROUP BY invoice_no)"""

BUYERS = """
usual AS (SELECT customer_id, country AS primary_country FROM (
  SELECT customer_id, country, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY COUNT(*) DESC, country) AS rn
  FROM known GROUP BY customer_id, country) WHERE rn = 1),
bought AS (SELECT customer_id, MIN(invoice_date) AS first_purchase, MAX(invoice_date) AS last_purchase,
  COUNT(DISTINCT invoice_no) AS orders, SUM(line_revenue) AS revenue, CAST(SUM(quantity) AS BIGINT) AS units,
  COUNT(DISTINCT stock_code) AS distinct_products FROM known GROUP BY customer_id),
buyers AS MATERIALIZED (SELECT b.*, primary_country FROM bought b JOIN usual USING (customer_id))"""


def qbin(rank: str, n: str, q: int) -> str:
    return f"GREATEST(1, ((({rank}) - 1) * {q} + ({n}) - 2) // (({n}) - 1))"


RFM = f"""{BUYERS},
feat AS (SELECT customer_id, primary_country, first_purchase, last_purchase,
  date_diff('day', CAST(last_purchase AS DATE), (SELECT CAST(MAX(invoice_date) AS DATE) + 1 FROM known)) AS recency_days,
  orders AS frequency_orders, {dbl('revenue')} AS monetary_value_gbp, {ratio('revenue', 'orders')} AS average_order_value_gbp,
  date_diff('day', CAST(first_purchase AS DATE), CAST(last_purchase AS DATE)) AS active_span_days,
  units AS units_purchased, distinct_products, revenue FROM buyers),
places AS (SELECT *, COUNT(*) OVER () AS n,
  ROW_NUMBER() OVER (ORDER BY recency_days DESC, customer_id) AS pr,
  ROW_NUMBER() OVER (ORDER BY frequency_orders, customer_id) AS pf,
  ROW_NUMBER() OVER (ORDER BY revenue, customer_id) AS pm FROM feat),
scores AS (SELECT *, {qbin('pr', 'n', 5)} AS r_score, {qbin('pf', 'n', 5)} AS f_score, {qbin('pm', 'n', 5)} AS m_score FROM places),
rfm AS MATERIALIZED (SELECT *, r_score + f_score + m_score AS rfm_score,
  CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_code,
  CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 AND frequency_orders >= 2 THEN 'Champions'
    WHEN r_score >= 3 AND f_score >= 4 AND m_score >= 3 AND frequency_orders >= 2 THEN 'Loyal Customers'
    WHEN r_score >= 4 AND f_score IN (2, 3) AND m_score >= 2 AND frequency_orders >= 2 THEN 'Potential Loyalists'
    WHEN r_score >= 4 AND frequency_orders = 1 THEN 'New Customers'
    WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 AND frequency_orders >= 2 THEN 'Cannot Lose Them'
    WHEN r_score <= 2 AND (f_score >= 3 OR m_score >= 3) THEN 'At Risk'
    WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating'
    ELSE 'Need Attention' END AS segment FROM scores)"""

PLAN = "plan(segment, segment_order, segment_rule, recommended_action, priority) AS (VALUES " + ", ".join(
    f"('{s}', {i + 1}, '{r}', '{a}', '{p}')" for i, (s, r, a, p) in enumerate(SEGMENTS)
) + ")"

COHORT = f"""
cm AS (SELECT DISTINCT customer_id, month_start AS purchase_month FROM known),
cf AS (SELECT customer_id, MIN(purchase_month) AS acquisition_month FROM cm GROUP BY customer_id),
cc AS (SELECT acquisition_month, purchase_month, COUNT(*) AS active FROM cm JOIN cf USING (customer_id) GROUP BY ALL),
cl AS (SELECT MAX(invoice_date)::DATE AS last_day FROM known),
cs AS (SELECT acquisition_month, COUNT(*) AS cohort_size FROM cf GROUP BY acquisition_month),
spine AS (SELECT acquisition_month, cohort_size,
  CAST(UNNEST(generate_series(acquisition_month, date_trunc('month', last_day), INTERVAL 1 MONTH)) AS DATE) AS purchase_month, last_day
  FROM cs, cl),
cohort AS MATERIALIZED (SELECT s.acquisition_month, s.purchase_month,
  (EXTRACT(year FROM s.purchase_month) - EXTRACT(year FROM s.acquisition_month)) * 12
    + EXTRACT(month FROM s.purchase_month) - EXTRACT(month FROM s.acquisition_month) AS cohort_month_index,
  cohort_size, COALESCE(active, 0) AS active_customers,
  {rounded('COALESCE(active, 0)', 'cohort_size', 100)} AS retention_pct,
  strftime(s.purchase_month, '%Y-%m') = strftime(last_day, '%Y-%m') AND last_day < last_day(last_day) AS is_partial_period
  FROM spine s LEFT JOIN cc USING (acquisition_month, purchase_month))"""

STAR = f"""
latest AS (SELECT stock_code, COALESCE(description, 'Unknown product') AS product_description FROM (
  SELECT stock_code, description, ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY invoice_date DESC, description DESC NULLS LAST) AS rn
  FROM lines WHERE stock_code IS NOT NULL) WHERE rn = 1),
dim_product AS (SELECT ROW_NUMBER() OVER (ORDER BY stock_code) AS product_key, * FROM latest),
dim_country AS (SELECT ROW_NUMBER() OVER (ORDER BY country_name) AS country_key, country_name
  FROM (SELECT DISTINCT country AS country_name FROM lines WHERE country IS NOT NULL)),
{BUYERS.strip()},
dim_customer AS (SELECT ROW_NUMBER() OVER (ORDER BY customer_id) AS customer_key, customer_id, primary_country,
  CAST(first_purchase AS DATE) AS first_purchase_date, CAST(last_purchase AS DATE) AS last_purchase_date FROM buyers),
dim_date AS (SELECT DISTINCT CAST(strftime(invoice_date, '%Y%m%d') AS INTEGER) AS date_key, CAST(invoice_date AS DATE) AS full_date,
  EXTRACT(year FROM invoice_date) AS year, EXTRACT(quarter FROM invoice_date) AS quarter, EXTRACT(month FROM invoice_date) AS month,
  monthname(invoice_date) AS month_name, year_month, EXTRACT(day FROM invoice_date) AS day_of_month,
  dayname(invoice_date) AS day_of_week, EXTRACT(isodow FROM invoice_date) AS day_of_week_number,
  CASE WHEN EXTRACT(isodow FROM invoice_date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM lines WHERE invoice_date IS NOT NULL),
keyed AS (SELECT l.*, CAST(strftime(invoice_date, '%Y%m%d') AS INTEGER) AS date_key, COALESCE(p.product_key, 0) AS product_key,
  c.customer_key, COALESCE(k.country_key, 0) AS country_key FROM lines l LEFT JOIN dim_product p USING (stock_code)
  LEFT JOIN dim_customer c USING (customer_id) LEFT JOIN dim_country k ON l.country = k.country_name),
fact_sales AS MATERIALIZED (SELECT * FROM keyed WHERE transaction_type = 'completed_sale'),
fact_returns AS MATERIALIZED (SELECT * FROM keyed WHERE transaction_type = 'return_or_cancellation'),
audit AS (SELECT * FROM keyed WHERE transaction_type = 'excluded_non_sale')"""

SALES_KPI = f"""kpi AS (SELECT SUM(line_revenue) AS revenue, COUNT(DISTINCT invoice_no) AS orders, COUNT(DISTINCT customer_key) AS customers,
  SUM(CASE WHEN customer_key IS NOT NULL THEN line_revenue ELSE 0 END) AS known_revenue FROM fact_sales)"""

# Fences of the sample lines lie above every value, as the checks on
# outlier_thresholds show; flags are still computed from them.
FENCES = "fence AS (SELECT " + ", ".join(
    f"quantile_cont({dbl(m)}, 0.75) + 1.5 * (quantile_cont({dbl(m)}, 0.75) - quantile_cont({dbl(m)}, 0.25)) AS {m}_upper"
    for m in ("quantity", "unit_price", "line_revenue")
) + " FROM sales)"


def over(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


ORACLE: dict[str, str] = {}


def add(name: str, ctes: list[str], select: str) -> None:
    ORACLE[name] = over(*ctes) + "\n" + select if ctes else select


# Scans ----------------------------------------------------------------------

# Untidy text as the raw batches carry it, then the standard form of it.
CODE = "CAST(substr(stock_code, 2) AS BIGINT)"
SCANNED = f"""
scanned AS MATERIALIZED (SELECT invoice_no, stock_code, description,
  CASE WHEN {CODE} % 97 = 0 THEN NULL ELSE quantity END AS quantity,
  CASE WHEN {CODE} % 89 = 0 THEN NULL ELSE invoice_date END AS invoice_date,
  CASE WHEN {CODE} % 83 = 0 THEN NULL ELSE unit_price END AS unit_price, customer_id, country,
  CASE WHEN load_seq >= {SHIFT} THEN 'batch_2' ELSE 'batch_1' END AS source_batch, load_seq FROM txn)"""

add("scan_union_batches", [TXN, SCANNED], f"""SELECT source_batch, country, COUNT(*) AS row_count, COUNT(quantity) AS quantities,
  {dbl('SUM(unit_price)')} AS price_total FROM scanned GROUP BY source_batch, country""")
add("picked_columns", [], " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS picked, COUNT({c}) AS known, {dbl(f'MAX({c})')} AS greatest FROM {t}"
    for t, c in (("orders", "o_totalprice"), ("customer", "c_acctbal"), ("lineitem", "l_quantity"), ("part", "p_retailprice"))))
add("alias_columns", [TXN], f"""SELECT '  ' || invoice_no || chr(9) AS invoice_no, ' ' || stock_code AS stock_code,
  ' ' || replace(description, ' ', '  ') || ' ' AS description,
  CASE WHEN {CODE} % 97 = 0 THEN 'n/a' ELSE CAST(quantity AS VARCHAR) END AS quantity,
  CASE WHEN {CODE} % 89 = 0 THEN 'not a date' ELSE strftime(invoice_date, '%Y-%m-%d %H:%M') END AS invoice_date,
  CASE WHEN {CODE} % 83 = 0 THEN 'free' ELSE CAST(unit_price AS VARCHAR) END AS unit_price,
  customer_id || '.0' AS customer_id, country || ' ' AS country FROM txn""")
add("csv_roundtrip", [LINES], f"SELECT transaction_line_id, invoice_no, invoice_date, {dbl('unit_price')} AS unit_price FROM lines")
add("parquet_roundtrip", [LINES], f"""SELECT transaction_type, year, COUNT(*) AS row_count, {dbl('SUM(line_revenue)')} AS value
  FROM lines GROUP BY transaction_type, year""")
add("partition_datasets", [LINES], " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, COUNT(*) AS row_count, {dbl('SUM(line_revenue)')} AS value FROM lines WHERE {w}"
    for n, w in (
        ("completed_sales", "transaction_type = 'completed_sale'"),
        ("returns", "transaction_type = 'return_or_cancellation'"),
        ("excluded_records", "transaction_type = 'excluded_non_sale'"),
        ("customer_sales", "transaction_type = 'completed_sale' AND has_customer_id"),
        ("anonymous_sales", "transaction_type = 'completed_sale' AND NOT has_customer_id"),
    )))

EXEC = f"""SELECT {rounded('revenue', '1')} AS revenue_gbp, orders, customers AS identified_customers,
  {rounded('revenue', 'orders')} AS average_order_value_gbp, {rounded('known_revenue', 'customers')} AS revenue_per_identified_customer_gbp FROM kpi"""
RECON = """SELECT *, completed_sales + returns_or_cancellations + excluded_non_sales AS reconciled_unique_rows FROM (SELECT
  (SELECT COUNT(*) FROM fact_sales) AS completed_sales, (SELECT COUNT(*) FROM fact_returns) AS returns_or_cancellations,
  (SELECT COUNT(*) FROM audit) AS excluded_non_sales)"""
OUTLIERS = f"""SELECT {big('SUM(CASE WHEN quantity > quantity_upper THEN 1 ELSE 0 END)')} AS quantity_outlier_lines,
  {big('SUM(CASE WHEN unit_price > unit_price_upper THEN 1 ELSE 0 END)')} AS price_outlier_lines,
  {big('SUM(CASE WHEN line_revenue > line_revenue_upper THEN 1 ELSE 0 END)')} AS revenue_outlier_lines,
  {dbl('SUM(CASE WHEN line_revenue > line_revenue_upper THEN line_revenue ELSE 0 END)')} AS flagged_revenue_gbp FROM fact_sales, fence"""
add("executive_kpis", [LINES, STAR, SALES_KPI], EXEC)
add("partition_reconciliation", [LINES, STAR], RECON)
add("outlier_profile", [LINES, STAR, FENCES], OUTLIERS)


def unpivoted(query: str, source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{query}' AS query, '{c}' AS measure, {dbl(c)} AS value FROM {source}" for c in columns
    )


KPI_COLUMNS = ["revenue_gbp", "orders", "identified_customers", "average_order_value_gbp",
               "revenue_per_identified_customer_gbp"]
RECON_COLUMNS = ["completed_sales", "returns_or_cancellations", "excluded_non_sales", "reconciled_unique_rows"]
OUTLIER_COLUMNS = ["quantity_outlier_lines", "price_outlier_lines", "revenue_outlier_lines", "flagged_revenue_gbp"]
MANIFEST = {
    "foreign_key_resolution": ("5", "check_name,failure_count"),
    "partition_reconciliation": ("1", ",".join(RECON_COLUMNS)),
    "sales_value_reconciliation": ("1", "completed_sales_value_gbp,completed_orders,identified_customers,anonymous_sales_lines"),
    "returns_value_reconciliation": ("1", "signed_returns_value_gbp,return_or_cancellation_invoices"),
    "executive_kpis": ("1", ",".join(KPI_COLUMNS)),
    "monthly_revenue_growth": ("(SELECT COUNT(DISTINCT year_month) FROM fact_sales)", "year_month,revenue_gbp,orders,month_over_month_growth_pct"),
    "country_performance": ("(SELECT COUNT(DISTINCT country_key) FROM fact_sales)", "country_name,revenue_gbp,orders,identified_customers,average_order_value_gbp"),
    "top_products": ("(SELECT LEAST(20, COUNT(DISTINCT product_key)) FROM fact_sales)", "stock_code,product_description,units_sold,revenue_gbp,order_count"),
    "top_customers": ("(SELECT LEAST(20, COUNT(DISTINCT customer_key)) FROM fact_sales)", "customer_id,primary_country,orders,customer_revenue_gbp,average_order_value_gbp,first_purchase,last_purchase"),
    "repeat_customer_rate": ("1", "identified_customers,repeat_customers,repeat_customer_rate_pct"),
    "product_returns": ("(SELECT LEAST(20, COUNT(DISTINCT product_key)) FROM fact_returns)", "stock_code,product_description,return_invoices,returned_units,absolute_return_value_gbp"),
    "customer_revenue_deciles": ("(SELECT LEAST(10, COUNT(DISTINCT customer_key)) FROM fact_sales)", "value_decile,customers,revenue_gbp,revenue_share_pct"),
    "outlier_profile": ("1", ",".join(OUTLIER_COLUMNS)),
}
add("query_manifest", [LINES, STAR], " UNION ALL ".join(
    f"SELECT '{n}' AS query, {big(rows)} AS row_count, '{cols}' AS column_list" for n, (rows, cols) in MANIFEST.items()))
add("star_row_counts", [LINES, STAR], " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {s}" for n, s in (
        ("dim_date", "dim_date"), ("dim_product", "dim_product"), ("dim_customer", "dim_customer"),
        ("dim_country", "dim_country"), ("fact_sales", "fact_sales"), ("fact_returns", "fact_returns"),
        ("audit_exclusions", "audit"))))

# Scalars --------------------------------------------------------------------

add("standardize", [TXN, SCANNED], f"""SELECT invoice_no, stock_code, description, quantity, invoice_date, {dbl('unit_price')} AS unit_price,
  customer_id, country, {dbl('CAST(quantity * unit_price AS DECIMAL(18,4))')} AS line_revenue, source_batch FROM scanned""")
add("coerce_types", [TXN, SCANNED], f"""SELECT COUNT(*) AS row_count, COUNT(quantity) AS quantities, COUNT(invoice_date) AS dates,
  COUNT(unit_price) AS prices, {big('SUM(quantity)')} AS quantity_total, {dbl('SUM(unit_price)')} AS price_total,
  MAX(invoice_date) AS last_date FROM scanned""")
add("clean_id", [], """SELECT o_orderkey, CASE WHEN o_custkey % 7 > 1 THEN CAST(o_custkey AS VARCHAR) END AS mart_id,
  CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 7 = 1 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '.0' END AS scan_id FROM orders""")
add("clean_numeric", [], f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0.0::DOUBLE
  ELSE {dbl('CAST(o_totalprice AS DECIMAL(12,2))')} END AS price FROM orders""")
add("classify_lines", [TXN, f"f AS (SELECT *, {FLAGS} FROM txn)", f"k AS (SELECT *, {KIND} FROM f)"],
    f"""SELECT transaction_type, is_cancelled, is_return, is_completed_sale, has_customer_id, COUNT(*) AS row_count,
  {dbl('SUM(line_revenue)')} AS value FROM k GROUP BY ALL""")
add("exclusion_reasons", [TXN, """holed AS (SELECT * REPLACE (
    CASE WHEN EXTRACT(day FROM invoice_date) % 9 <> 0 THEN invoice_no END AS invoice_no,
    CASE WHEN EXTRACT(day FROM invoice_date) % 7 = 0 THEN 0 ELSE quantity END AS quantity,
    CASE WHEN EXTRACT(day FROM invoice_date) % 5 <> 0 THEN unit_price END AS unit_price) FROM txn)""",
    f"f AS (SELECT *, {FLAGS} FROM holed)", f"k AS (SELECT *, {KIND} FROM f)"],
    "SELECT transaction_type, exclusion_reason, COUNT(*) AS row_count FROM k GROUP BY ALL")
add("date_features", [], """SELECT event_id, CAST(ts AS DATE) AS invoice_day, EXTRACT(year FROM ts) AS year, EXTRACT(quarter FROM ts) AS quarter,
  EXTRACT(month FROM ts) AS month, strftime(ts, '%Y-%m') AS year_month, EXTRACT(day FROM ts) AS day_of_month,
  dayname(ts) AS day_of_week, EXTRACT(hour FROM ts) AS hour FROM events""")
add("month_marts", [], f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, COUNT(*) AS orders,
  {dbl('SUM(CAST(o_totalprice AS DECIMAL(18,4)))')} AS value FROM orders GROUP BY 1""")
add("scalar_math", [], """SELECT event_id, round(abs(value), 6) AS absolute, round(ln(1 + abs(value)), 6) AS log_value,
  LEAST(value, 100.0) AS clipped, value BETWEEN 10 AND 20 AS in_band, substr(event_type, 1, 4) AS short_type FROM events""")
MAGNITUDE = "CASE WHEN abs(effect) < 0.1 THEN 'negligible' WHEN abs(effect) < 0.3 THEN 'small' WHEN abs(effect) < 0.5 THEN 'moderate' ELSE 'large' END"
add("effect_magnitude", [LINES], f"""SELECT customer_id, effect, {MAGNITUDE} AS magnitude FROM (SELECT customer_id,
  {ratio('SUM(quantity)', 'SUM(abs(quantity))')} AS effect FROM lines WHERE customer_id IS NOT NULL GROUP BY customer_id)""")

# Filters, duplicates, ranks -------------------------------------------------

add("identified_sales", [LINES], f"""SELECT country, COUNT(*) AS row_count, COUNT(DISTINCT customer_id) AS customers,
  {dbl('SUM(line_revenue)')} AS value FROM known GROUP BY country""")
OVERLAP = f"""both_loads AS (SELECT * FROM txn UNION ALL SELECT * REPLACE ({2 * SHIFT} + load_seq % {SHIFT} AS load_seq) FROM txn
  WHERE invoice_date < TIMESTAMP '1997-01-01')"""
BATCH3 = f"CASE load_seq // {SHIFT} WHEN 0 THEN 'batch_1' WHEN 1 THEN 'batch_2' ELSE 'batch_3' END"
add("dedup_exact", [TXN, OVERLAP, f"u AS (SELECT {IDS}, MIN(load_seq) AS load_seq FROM both_loads GROUP BY {IDS})"],
    f"SELECT {BATCH3} AS source_batch, country, COUNT(*) AS row_count, {big('SUM(quantity)')} AS quantity FROM u GROUP BY 1, 2")
add("raw_profile", [TXN, OVERLAP, f"f AS (SELECT *, {FLAGS}, {BATCH3} AS batch FROM both_loads)"], f"""SELECT COUNT(*) AS total,
  COUNT(*) FILTER (is_completed_sale) AS completed_sales, COUNT(*) FILTER (is_return) AS returns_or_cancellations,
  COUNT(*) FILTER (customer_id IS NULL) AS anonymous_rows, COUNT(*) FILTER (unit_price <= 0) AS non_positive_price_rows,
  COUNT(*) FILTER (quantity <= 0) AS non_positive_quantity_rows, COUNT(*) FILTER (invoice_date IS NULL) AS unparseable_date_rows,
  MIN(invoice_date) AS minimum_invoice_date, MAX(invoice_date) AS maximum_invoice_date,
  string_agg(DISTINCT batch, ',' ORDER BY batch) AS source_batches, COUNT(DISTINCT country) AS countries,
  COUNT(DISTINCT stock_code) AS products, COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT invoice_no) AS invoices,
  {dbl('SUM(line_revenue)')} AS all_signed_value, {dbl('SUM(line_revenue) FILTER (is_completed_sale)')} AS completed_sales_value,
  {dbl('SUM(line_revenue) FILTER (is_return)')} AS returns_value,
  COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {IDS}, batch FROM f)) AS duplicates_within_batch,
  COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {IDS} FROM f)) AS duplicates_across_batches FROM f""")
add("missing_values", [TXN, SCANNED], "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS missing_count, "
    f"{rounded(f'COUNT(*) FILTER ({c} IS NULL)', 'COUNT(*)', 100, 4)} AS missing_pct FROM scanned"
    for c in [*IDENTITY, "load_seq"]) + ") WHERE missing_count > 0")
add("line_ids", [LINES], f"""SELECT transaction_line_id, invoice_no, stock_code, description, quantity, invoice_date,
  {dbl('unit_price')} AS unit_price, customer_id, country, source_batch, transaction_type FROM lines""")
add("latest_description", [LINES, STAR], "SELECT stock_code, product_description AS description FROM latest")
add("global_row_number", [], """SELECT ROW_NUMBER() OVER (ORDER BY event_type, value DESC, event_id) AS place, event_id, event_type, value FROM events""")


def shared_rank(column: str) -> str:
    """Average rank over ties."""
    return f"(RANK() OVER (ORDER BY {column}) + (COUNT(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE)"


add("avg_rank", [LINES, RFM], "SELECT customer_id, " + ", ".join(
    f"{shared_rank(c)} AS rank_{c}" for c in ("recency_days", "frequency_orders", "distinct_products")) + " FROM rfm")
add("holm_adjust", [LINES, """c AS (SELECT country, """ + ", ".join(
    f"{dbl(f'COUNT(*) FILTER (transaction_type = {k!r})')} AS o{i}" for i, k in enumerate(
        ("completed_sale", "return_or_cancellation", "excluded_non_sale"))) + " FROM lines GROUP BY country)",
    "w AS (SELECT SUM(o0) AS w0, SUM(o1) AS w1, SUM(o2) AS w2, SUM(o0 + o1 + o2) AS w FROM c)",
    """t AS (SELECT r_name AS family, country, exp(-x / 2) AS p_value FROM (SELECT country, """ + " + ".join(
        f"power(o{i} - (o0+o1+o2) * w{i} / w, 2) / ((o0+o1+o2) * w{i} / w)" for i in range(3)) +
    """ AS x FROM c, w) JOIN nation ON country = n_name JOIN region ON n_regionkey = r_regionkey)""",
    """s AS (SELECT *, LEAST(1.0, p_value * (COUNT(*) OVER (PARTITION BY family)
      - ROW_NUMBER() OVER (PARTITION BY family ORDER BY p_value, country) + 1)) AS step FROM t)"""],
    """SELECT family, country, round(p_value, 9) AS p_value, round(MAX(step) OVER (PARTITION BY family ORDER BY p_value, country
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS adjusted_p_value FROM s""")
add("top_n_by", [LINES], f"""SELECT substr(description, 1, 42) AS label, description, {dbl('v')} AS line_revenue FROM (
  SELECT description, SUM(line_revenue) AS v FROM sales WHERE description IS NOT NULL GROUP BY description ORDER BY v DESC, description LIMIT 10)""")

# Named statements -----------------------------------------------------------

add("monthly_revenue_growth", [LINES, STAR, """m AS (SELECT year_month, SUM(line_revenue) AS revenue, COUNT(DISTINCT invoice_no) AS orders
  FROM fact_sales GROUP BY year_month)""", "p AS (SELECT *, LAG(revenue) OVER (ORDER BY year_month) AS prev FROM m)"],
    f"""SELECT year_month, {dbl('revenue')} AS revenue_gbp, orders,
  CASE WHEN prev IS NOT NULL THEN {rounded('revenue - prev', 'prev', 100)} END AS month_over_month_growth_pct FROM p""")
add("country_performance", [LINES, STAR], f"""SELECT country_name, {dbl('SUM(line_revenue)')} AS revenue_gbp, COUNT(DISTINCT invoice_no) AS orders,
  COUNT(DISTINCT customer_key) AS identified_customers, {rounded('SUM(line_revenue)', 'COUNT(DISTINCT invoice_no)')} AS average_order_value_gbp
  FROM fact_sales JOIN dim_country USING (country_key) GROUP BY country_name""")
add("top_products", [LINES, STAR], f"""SELECT stock_code, product_description, {big('units')} AS units_sold, {dbl('v')} AS revenue_gbp, orders AS order_count
  FROM (SELECT p.stock_code, p.product_description, SUM(quantity) AS units, SUM(line_revenue) AS v, COUNT(DISTINCT invoice_no) AS orders
  FROM fact_sales f JOIN dim_product p USING (product_key) GROUP BY ALL ORDER BY v DESC, p.stock_code LIMIT 20)""")
add("top_customers", [LINES, STAR], f"""SELECT customer_id, primary_country, orders, {dbl('v')} AS customer_revenue_gbp,
  {rounded('v', 'orders')} AS average_order_value_gbp, first_purchase, last_purchase FROM (
  SELECT c.customer_id, c.primary_country, COUNT(DISTINCT invoice_no) AS orders, SUM(line_revenue) AS v,
  CAST(MIN(invoice_date) AS DATE) AS first_purchase, CAST(MAX(invoice_date) AS DATE) AS last_purchase
  FROM fact_sales f JOIN dim_customer c USING (customer_key) GROUP BY c.customer_id, c.primary_country ORDER BY v DESC, c.customer_id LIMIT 20)""")
add("repeat_customer_rate", [LINES, STAR, "o AS (SELECT customer_key, COUNT(DISTINCT invoice_no) AS n FROM fact_sales WHERE customer_key IS NOT NULL GROUP BY 1)"],
    f"""SELECT COUNT(*) AS identified_customers, COUNT(*) FILTER (n > 1) AS repeat_customers,
  {rounded('COUNT(*) FILTER (n > 1)', 'COUNT(*)', 100)} AS repeat_customer_rate_pct FROM o""")
add("product_returns", [LINES, STAR], f"""SELECT stock_code, product_description, return_invoices, {big('units')} AS returned_units, {dbl('v')} AS absolute_return_value_gbp
  FROM (SELECT p.stock_code, p.product_description, COUNT(DISTINCT invoice_no) AS return_invoices, SUM(abs(quantity)) AS units, abs(SUM(line_revenue)) AS v
  FROM fact_returns JOIN dim_product p USING (product_key) GROUP BY ALL ORDER BY v DESC, p.stock_code LIMIT 20)""")
add("customer_revenue_deciles", [LINES, STAR, """cv AS (SELECT customer_key, SUM(line_revenue) AS revenue FROM fact_sales WHERE customer_key IS NOT NULL GROUP BY 1)""",
    "r AS (SELECT *, NTILE(10) OVER (ORDER BY revenue DESC, customer_key) AS value_decile FROM cv)",
    "tot AS (SELECT SUM(revenue) AS total FROM cv)"],
    f"""SELECT value_decile, COUNT(*) AS customers, {dbl('SUM(revenue)')} AS revenue_gbp,
  {rounded('SUM(revenue)', 'ANY_VALUE(total)', 100)} AS revenue_share_pct FROM r, tot GROUP BY value_decile""")
add("foreign_key_resolution", [LINES, STAR], " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, COUNT(*) AS failure_count FROM {f} f WHERE NOT EXISTS (SELECT 1 FROM {d} d WHERE d.{k} = f.{k})"
    for n, f, d, k in (
        ("orphan_sales_dates", "fact_sales", "dim_date", "date_key"),
        ("orphan_sales_products", "fact_sales", "dim_product", "product_key"),
        ("orphan_sales_countries", "fact_sales", "dim_country", "country_key"),
        ("orphan_return_dates", "fact_returns", "dim_date", "date_key"),
        ("orphan_return_products", "fact_returns", "dim_product", "product_key"))))
add("sales_value_reconciliation", [LINES, STAR], f"""SELECT {dbl('SUM(line_revenue)')} AS completed_sales_value_gbp, COUNT(DISTINCT invoice_no) AS completed_orders,
  COUNT(DISTINCT customer_key) AS identified_customers, COUNT(*) FILTER (customer_key IS NULL) AS anonymous_sales_lines FROM fact_sales""")
add("returns_value_reconciliation", [LINES, STAR], f"""SELECT {dbl('SUM(line_revenue)')} AS signed_returns_value_gbp,
  COUNT(DISTINCT invoice_no) AS return_or_cancellation_invoices FROM fact_returns""")

# Descriptive tables ---------------------------------------------------------

add("order_summary", [LINES, ORDER_SUMMARY], f"SELECT * EXCLUDE (order_value), {dbl('order_value')} AS order_value_gbp FROM osum")
add("customer_summary", [LINES, BUYERS], f"""SELECT customer_id, primary_country, first_purchase, last_purchase, orders, units, distinct_products,
  {dbl('revenue')} AS customer_revenue_gbp, {ratio('revenue', 'orders')} AS average_order_value_gbp,
  date_diff('day', CAST(first_purchase AS DATE), CAST(last_purchase AS DATE)) AS active_span_days, orders > 1 AS is_repeat_customer FROM buyers""")
MONTHLY = f"""lm AS (SELECT year_month, {dbl('SUM(line_revenue)')} AS revenue_gbp, {big('SUM(quantity)')} AS units, COUNT(*) AS sales_lines,
  COUNT(DISTINCT customer_id) AS identified_customers FROM sales GROUP BY year_month),
om AS (SELECT strftime(invoice_date, '%Y-%m') AS year_month, COUNT(*) AS orders, {ratio('SUM(order_value)', 'COUNT(*)')} AS average_order_value_gbp,
  quantile_cont({dbl('order_value')}, 0.5) AS median_order_value_gbp FROM osum GROUP BY 1),
ld AS (SELECT CAST(MAX(invoice_date) AS DATE) AS d FROM sales),
monthly AS (SELECT lm.*, orders, average_order_value_gbp, median_order_value_gbp,
  (revenue_gbp / LAG(revenue_gbp) OVER (ORDER BY lm.year_month) - 1) * 100 AS month_over_month_growth_pct,
  lm.year_month = strftime(d, '%Y-%m') AND d < last_day(d) AS is_partial_period FROM lm LEFT JOIN om USING (year_month), ld)"""
add("monthly_performance", [LINES, ORDER_SUMMARY, MONTHLY], "SELECT * REPLACE (round(median_order_value_gbp, 6) AS median_order_value_gbp) FROM monthly")
add("complete_months", [LINES, ORDER_SUMMARY, MONTHLY], "SELECT year_month, revenue_gbp, orders FROM monthly WHERE NOT is_partial_period")
add("country_share", [LINES, "tot AS (SELECT SUM(line_revenue) AS total FROM sales)"], f"""SELECT country, {dbl('SUM(line_revenue)')} AS revenue_gbp,
  COUNT(DISTINCT invoice_no) AS orders, COUNT(DISTINCT customer_id) AS identified_customers, {big('SUM(quantity)')} AS units,
  {ratio('SUM(line_revenue)', 'COUNT(DISTINCT invoice_no)')} AS average_order_value_gbp,
  {ratio('SUM(line_revenue)', 'ANY_VALUE(total)', 100)} AS revenue_share_pct FROM sales, tot GROUP BY country""")


def newest(source: str) -> str:
    return f"""newest AS (SELECT stock_code, COALESCE(description, 'Unknown product') AS description FROM (SELECT stock_code, description,
  ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY invoice_date DESC, description DESC NULLS LAST) AS rn FROM {source}) WHERE rn = 1)"""


add("product_performance", [LINES, newest("sales"), "tot AS (SELECT SUM(line_revenue) AS total FROM sales)"], f"""SELECT stock_code,
  {big('SUM(quantity)')} AS units_sold, {dbl('SUM(line_revenue)')} AS revenue_gbp, COUNT(DISTINCT invoice_no) AS orders,
  COUNT(DISTINCT customer_id) AS identified_customers, ANY_VALUE(n.description) AS description,
  {ratio('SUM(line_revenue)', 'ANY_VALUE(total)', 100)} AS revenue_share_pct FROM sales JOIN newest n USING (stock_code), tot GROUP BY stock_code""")
add("return_product_performance", [LINES, newest("returns")], f"""SELECT stock_code, {big('SUM(abs(quantity))')} AS returned_units,
  {dbl('SUM(line_revenue)')} AS signed_return_value_gbp, COUNT(DISTINCT invoice_no) AS return_invoices, ANY_VALUE(n.description) AS description,
  abs({dbl('SUM(line_revenue)')}) AS absolute_return_value_gbp FROM returns JOIN newest n USING (stock_code) GROUP BY stock_code""")
add("weekday_performance", [LINES], f"""SELECT dayname(invoice_date) AS day_of_week, {dbl('SUM(line_revenue)')} AS revenue_gbp,
  COUNT(DISTINCT invoice_no) AS orders, EXTRACT(isodow FROM invoice_date) AS weekday_order FROM sales GROUP BY 1, 4""")
add("hourly_performance", [], f"""SELECT EXTRACT(hour FROM ts) AS hour, {dbl('SUM(CAST(value AS DECIMAL(18,4)))')} AS revenue_gbp,
  COUNT(DISTINCT event_id) AS orders FROM events GROUP BY 1""")
DECILES = f"""rk AS (SELECT revenue, ROW_NUMBER() OVER (ORDER BY revenue DESC, customer_id) AS i, COUNT(*) OVER () AS n,
  SUM(revenue) OVER () AS total FROM buyers),
deciles AS (SELECT {qbin('i', 'n', 10)} AS value_decile, COUNT(*) AS customers, {dbl('SUM(revenue)')} AS revenue_gbp,
  {ratio('SUM(revenue)', 'ANY_VALUE(total)', 100)} AS revenue_share_pct FROM rk GROUP BY 1)"""
add("revenue_deciles_qcut", [LINES, BUYERS, DECILES], "SELECT * FROM deciles")
FLAGGED = "line_revenue > line_revenue_upper"
SUMMARY = f"""o AS (SELECT COUNT(*) AS orders, SUM(order_value) AS v, quantile_cont({dbl('order_value')}, 0.5) AS med FROM osum),
c AS (SELECT COUNT(*) AS customers, COUNT(*) FILTER (orders > 1) AS repeats FROM buyers),
b AS (SELECT SUM(line_revenue) AS back FROM returns),
d1 AS (SELECT revenue_share_pct AS top FROM deciles WHERE value_decile = 1),
s AS (SELECT COUNT(*) AS n, SUM(line_revenue) AS total, SUM(quantity) AS units, SUM(CASE WHEN customer_id IS NOT NULL THEN line_revenue ELSE 0 END) AS kn,
  SUM(CASE WHEN customer_id IS NULL THEN line_revenue ELSE 0 END) AS an, SUM(CASE WHEN {FLAGGED} THEN line_revenue ELSE 0 END) AS fl,
  COUNT(*) FILTER ({FLAGGED}) AS fn, CAST(MAX(invoice_date) AS DATE) AS d FROM sales, fence),
summary AS (SELECT n AS completed_sales_rows, {dbl('total')} AS completed_sales_value_gbp, orders, {big('units')} AS units_sold,
  {rounded('v', 'orders')} AS average_order_value_gbp, CAST(round(CAST(med AS DECIMAL(28,4)), 2) AS DOUBLE) AS median_order_value_gbp, customers AS identified_customers,
  repeats AS repeat_customers, {rounded('repeats', 'customers', 100)} AS repeat_customer_rate_pct, {dbl('kn')} AS identified_revenue_gbp,
  {dbl('an')} AS anonymous_revenue_gbp, {rounded('an', 'total', 100)} AS anonymous_revenue_share_pct, {dbl('back')} AS signed_returns_value_gbp,
  {rounded('abs(back)', 'total', 100)} AS absolute_return_value_to_sales_pct, fn AS line_revenue_outlier_rows,
  {rounded('fn', 'n', 100)} AS line_revenue_outlier_share_pct, {dbl('fl')} AS flagged_revenue_gbp, {rounded('fl', 'total', 100)} AS flagged_revenue_share_pct,
  round(top, 2) AS top_customer_decile_revenue_share_pct, d AS data_through_date,
  CASE WHEN d < last_day(d) THEN strftime(d, '%Y-%m') END AS partial_period FROM s, o, c, b, d1)"""
add("eda_summary", [LINES, ORDER_SUMMARY, BUYERS, DECILES, FENCES, SUMMARY], "SELECT * FROM summary")
add("kpi_snapshot", [LINES, ORDER_SUMMARY, BUYERS, DECILES, FENCES, SUMMARY], """SELECT data_through_date, completed_sales_value_gbp AS completed_revenue_gbp,
  orders AS completed_orders, units_sold AS completed_units, average_order_value_gbp, median_order_value_gbp, identified_customers, repeat_customers,
  repeat_customer_rate_pct, identified_revenue_gbp AS identified_customer_revenue_gbp, anonymous_revenue_gbp, anonymous_revenue_share_pct,
  signed_returns_value_gbp, partial_period, partial_period || ' holds data only through ' || CAST(data_through_date AS VARCHAR)
  || ' and is not a complete month.' AS partial_period_note FROM summary""")
EV = dbl("CAST(value AS DECIMAL(18,4))")
EVENT_FENCE = f"ef AS (SELECT quantile_cont({EV}, 0.75) + 1.5 * (quantile_cont({EV}, 0.75) - quantile_cont({EV}, 0.25)) AS top FROM events)"
add("outlier_thresholds", [LINES, FENCES, EVENT_FENCE], "SELECT " + ", ".join(
    f"round({c}_upper, 6) AS {c}_upper" for c in ("quantity", "unit_price", "line_revenue")) + ", round(top, 6) AS event_value_upper FROM fence, ef")
add("outlier_flags", [EVENT_FENCE], f"""SELECT event_type, COALESCE({EV} > top, FALSE) AS is_line_revenue_outlier, COUNT(*) AS row_count,
  {dbl('SUM(CAST(value AS DECIMAL(18,4)))')} AS value FROM events, ef GROUP BY 1, 2""")
add("cleaning_summary", [LINES, FENCES], f"""SELECT COUNT(*) AS unique_rows, COUNT(*) FILTER (is_completed_sale) AS completed_sales,
  COUNT(*) FILTER (transaction_type = 'return_or_cancellation') AS returns_or_cancellations,
  COUNT(*) FILTER (transaction_type = 'excluded_non_sale') AS excluded_non_sales,
  COUNT(*) FILTER (is_completed_sale AND has_customer_id) AS customer_sales, COUNT(*) FILTER (is_completed_sale AND NOT has_customer_id) AS anonymous_sales,
  {dbl('SUM(line_revenue) FILTER (is_completed_sale)')} AS completed_sales_value,
  {dbl("SUM(line_revenue) FILTER (transaction_type = 'return_or_cancellation')")} AS returns_value,
  COUNT(*) FILTER (customer_id IS NULL) AS missing_customer_id_rows, COUNT(*) FILTER (description IS NULL) AS missing_description_rows,
  """ + ", ".join(f"COUNT(*) FILTER (is_completed_sale AND {m} > {m}_upper) AS {m}_outliers" for m in ("quantity", "unit_price", "line_revenue")) + f""",
  (SELECT COUNT(*) FROM txn) AS input_rows, (SELECT COUNT(*) FROM txn) - COUNT(*) AS exact_duplicates_removed,
  COUNT(*) = COUNT(transaction_type) AS matches_unique_rows, """ + ", ".join(
      f"round(ANY_VALUE({m}_upper), 6) AS {m}_upper" for m in ("quantity", "unit_price", "line_revenue")) + " FROM lines, fence")
add("order_value_percentiles", [LINES, ORDER_SUMMARY], " UNION ALL ".join(
    f"SELECT 'p{round(p * 100)}' AS percentile, round(quantile_cont({dbl('order_value')}, {p}), 6) AS value FROM osum" for p in (0.25, 0.5, 0.75, 0.9, 0.99)))
RFM_FEATURES = ("recency_days", "frequency_orders", "monetary_value_gbp")
add("rfm_describe", [LINES, RFM], " UNION ALL ".join(
    f"SELECT '{c}' AS metric, COUNT({c}) AS count, round(AVG({dbl(c)}), 5) AS mean, round(STDDEV({dbl(c)}), 5) AS std, round(MIN({dbl(c)}), 5) AS min, "
    + ", ".join(f"round(quantile_cont({dbl(c)}, {p}), 5) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9))
    + f", round(MAX({dbl(c)}), 5) AS max FROM rfm" for c in RFM_FEATURES))


def histogram(name: str, source: str, value: str, bins: int, clip: bool) -> str:
    """CTEs that end in <name>(bin, bin_start, bin_end, count)."""
    cap = f"(SELECT quantile_cont({value}, 0.99) FROM {source})"
    kept = f"SELECT LEAST({value}, {cap}) AS v FROM {source}" if clip else f"SELECT {value} AS v FROM {source} WHERE {value} <= {cap}"
    return f"""{name}_v AS ({kept}), {name}_e AS (SELECT MIN(v) AS lo, (MAX(v) - MIN(v)) / {bins} AS w FROM {name}_v),
{name} AS (SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, COUNT(*) AS count FROM (
  SELECT CAST(LEAST(floor((v - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w FROM {name}_v, {name}_e) GROUP BY bin, lo, w)"""


add("order_value_histogram", [LINES, ORDER_SUMMARY, histogram("h", "osum", dbl("order_value"), 60, False)], "SELECT * FROM h")
add("rfm_histograms", [LINES, RFM, histogram("h1", "rfm", dbl("recency_days"), 45, True), histogram("h2", "rfm", dbl("frequency_orders"), 35, True)],
    "SELECT *, 'recency_days' AS metric FROM h1 UNION ALL SELECT *, 'frequency_orders' AS metric FROM h2")
add("customer_value_histogram", [LINES, BUYERS, f"lv AS (SELECT ln(1 + {dbl('revenue')}) AS v FROM buyers)", "e AS (SELECT MIN(v) AS lo, (MAX(v) - MIN(v)) / 60 AS w FROM lv)"],
    """SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, COUNT(*) AS count FROM (
  SELECT CAST(LEAST(floor((v - lo) / w), 59) AS INTEGER) AS bin, lo, w FROM lv, e) GROUP BY bin, lo, w""")
PLACE = f"CASE WHEN country = '{HOME}' THEN '{HOME}' ELSE 'International' END"
add("box_summary", [LINES, ORDER_SUMMARY, f"p AS (SELECT {PLACE} AS geography, {dbl('order_value')} AS v FROM osum)",
    "q AS (SELECT geography, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM p GROUP BY 1)"],
    """SELECT geography, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(MIN(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(MAX(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, COUNT(*) AS count
  FROM p JOIN q USING (geography) GROUP BY geography, q.q1, q.median, q.q3""")
add("revenue_splits", [LINES, FENCES], " UNION ALL ".join(
    f"SELECT '{s}' AS split, '{g}' AS line_group, {dbl(f'COALESCE(SUM(line_revenue) FILTER ({w}), 0)')} AS revenue_gbp FROM sales, fence"
    for s, g, w in (("identification", "Identified", "customer_id IS NOT NULL"), ("identification", "Anonymous", "customer_id IS NULL"),
                    ("outlier", "High-Revenue Flags", FLAGGED), ("outlier", "Other Sales Lines", f"NOT {FLAGGED}"))))

# Star -----------------------------------------------------------------------

for dim in ("dim_date", "dim_product", "dim_customer", "dim_country"):
    add(dim, [LINES, STAR], f"SELECT * FROM {dim}")
FACT = f"transaction_line_id, invoice_no, date_key, product_key, customer_key, country_key, quantity, {dbl('unit_price')} AS unit_price"
add("fact_keys", [LINES, STAR], "SELECT transaction_line_id, date_key, product_key, customer_key, country_key FROM keyed")
add("fact_sales", [LINES, STAR, FENCES], f"""SELECT {FACT}, {dbl('line_revenue')} AS line_revenue, CAST(quantity > quantity_upper AS INTEGER) AS is_quantity_outlier,
  CAST(unit_price > unit_price_upper AS INTEGER) AS is_unit_price_outlier, CAST(line_revenue > line_revenue_upper AS INTEGER) AS is_line_revenue_outlier FROM fact_sales, fence""")
add("fact_returns", [LINES, STAR], f"SELECT {FACT}, {dbl('line_revenue')} AS signed_return_value FROM fact_returns")
add("audit_exclusions", [LINES, STAR], f"SELECT transaction_line_id, invoice_no, stock_code, invoice_date, quantity, {dbl('unit_price')} AS unit_price, exclusion_reason FROM audit")
REQUIRED = {"dim_date": ["full_date", "year", "quarter", "month", "month_name", "year_month"], "dim_product": ["stock_code", "product_description"],
            "dim_customer": ["customer_id", "primary_country"], "dim_country": ["country_name"],
            "fact_sales": ["invoice_no", "date_key", "product_key", "country_key"],
            "fact_returns": ["invoice_no", "date_key", "product_key", "country_key", "quantity"], "audit_exclusions": ["exclusion_reason"]}
UNIQUE = [("dim_date", "date_key"), ("dim_date", "full_date"), ("dim_product", "product_key"), ("dim_product", "stock_code"), ("dim_customer", "customer_key"),
          ("dim_customer", "customer_id"), ("dim_country", "country_key"), ("dim_country", "country_name"), ("fact_sales", "transaction_line_id"),
          ("fact_returns", "transaction_line_id"), ("audit_exclusions", "transaction_line_id")]
RULES = [("dim_date", "is_weekend_binary", "is_weekend IN (0, 1)"), ("fact_sales", "quantity_positive", "quantity > 0"),
         ("fact_sales", "unit_price_positive", "unit_price > 0"), ("fact_sales", "line_revenue_positive", "line_revenue > 0"),
         *[("fact_sales", f"is_{m}_outlier_binary", f"CAST({m} > {m}_upper AS INTEGER) IN (0, 1)") for m in ("quantity", "unit_price", "line_revenue")]]


def stored(table: str) -> str:
    return "audit" if table == "audit_exclusions" else table


add("constraint_report", [LINES, STAR, FENCES], " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, '{c}_not_null' AS rule, COUNT(*) FILTER ({c} IS NULL) AS failures FROM {stored(t)}" for t, cs in REQUIRED.items() for c in cs]
    + [f"SELECT '{t}', '{r}', COUNT(*) FILTER (NOT ({w})) FROM {t}, fence" for t, r, w in RULES]
    + [f"SELECT '{t}', '{c}_unique', COUNT(*) - COUNT(DISTINCT {c}) FROM {stored(t)}" for t, c in UNIQUE]))

# Customers ------------------------------------------------------------------

RFM_COLUMNS = "customer_id, primary_country, first_purchase, last_purchase, recency_days, frequency_orders, monetary_value_gbp, average_order_value_gbp, active_span_days, units_purchased, distinct_products"
add("rfm_features", [LINES, RFM], f"SELECT {RFM_COLUMNS} FROM feat")
add("rfm_scores", [LINES, RFM], "SELECT customer_id, r_score, f_score, m_score, rfm_score, rfm_code FROM rfm")
add("rfm_segments", [LINES, RFM], "SELECT customer_id, segment, frequency_orders, monetary_value_gbp FROM rfm")
SEG = f"""sg AS (SELECT segment, COUNT(*) AS n, SUM(revenue) AS v, SUM(average_order_value_gbp) AS aov, SUM(frequency_orders) AS fo, SUM(units_purchased) AS up,
  SUM(distinct_products) AS dp, quantile_cont({dbl('recency_days')}, 0.5) AS mr, quantile_cont({dbl('frequency_orders')}, 0.5) AS mf,
  quantile_cont(monetary_value_gbp, 0.5) AS mm, COUNT(*) FILTER (frequency_orders >= 2) AS rep FROM rfm GROUP BY segment),
rt AS (SELECT COUNT(*) AS tn, SUM(revenue) AS tv FROM rfm)"""


def r6(x: str) -> str:
    return f"round({x}, 6)"


add("segment_summary", [LINES, RFM, PLAN, SEG], f"""SELECT segment, COALESCE(n, 0) AS customer_count, {r6(ratio('COALESCE(n, 0)', 'tn', 100))} AS customer_share_pct,
  {r6(dbl('COALESCE(v, 0)'))} AS monetary_value_gbp, {r6(ratio('COALESCE(v, 0)', 'tv', 100))} AS revenue_share_pct, {r6(ratio('v', 'n'))} AS average_monetary_value_gbp,
  {r6(ratio('aov', 'n'))} AS average_order_value_gbp, {r6('mr')} AS median_recency_days, {r6(ratio('fo', 'n'))} AS average_frequency_orders,
  {big('COALESCE(up, 0)')} AS units_purchased, {r6(ratio('dp', 'n'))} AS average_distinct_products, segment_rule, recommended_action, segment_order
  FROM plan LEFT JOIN sg USING (segment), rt""")
add("segment_action_plan", [LINES, RFM, PLAN, SEG], "SELECT segment, segment_order, priority, segment_rule, recommended_action, COALESCE(n, 0) AS customer_count FROM plan LEFT JOIN sg USING (segment)")
add("segment_mart", [LINES, RFM, PLAN, SEG], f"""SELECT segment AS rfm_segment, COALESCE(n, 0) AS customer_count, {r6(ratio('COALESCE(n, 0)', 'tn', 100))} AS customer_share_pct,
  {r6(dbl('COALESCE(v, 0)'))} AS historical_customer_value_gbp, {r6(ratio('COALESCE(v, 0)', 'tv', 100))} AS historical_value_share_pct, {r6('mr')} AS median_recency_days,
  {r6('mf')} AS median_frequency_orders, {r6('mm')} AS median_monetary_value_gbp, {r6(ratio('rep', 'n', 100))} AS repeat_customer_rate_pct,
  priority, segment_rule, recommended_action FROM plan LEFT JOIN sg USING (segment), rt""")
add("customer_summary_stats", [LINES, RFM], f"""SELECT (SELECT COUNT(*) FROM known) AS identified_completed_sales_rows, CAST(MAX(last_purchase) AS DATE) + 1 AS snapshot_date,
  COUNT(*) AS customers, CAST(MIN(first_purchase) AS DATE) AS first_purchase, CAST(MAX(last_purchase) AS DATE) AS last_purchase,
  {dbl('SUM(revenue)')} AS total_monetary_value_gbp, {rounded('SUM(recency_days)', 'COUNT(*)')} AS average_recency_days,
  {rounded('SUM(frequency_orders)', 'COUNT(*)')} AS average_frequency_orders, {rounded('SUM(revenue)', 'COUNT(*)')} AS average_customer_value_gbp, """
    + ", ".join(f"COUNT(*) FILTER (segment = '{s[0]}') AS segment_{s[0].lower().replace(' ', '_')}" for s in SEGMENTS) + " FROM rfm")
add("cohort_long", [LINES, COHORT], "SELECT * FROM cohort")
# The sample's months run from 1995-01 to 2001-08.
WIDTH = 80
for name, value in (("cohort_counts_wide", "active_customers"), ("cohort_retention_wide", "retention_pct")):
    add(name, [LINES, COHORT], "SELECT strftime(acquisition_month, '%Y-%m') AS acquisition_month, " + ", ".join(
        f"MAX({value}) FILTER (cohort_month_index = {i}) AS month_{i}" for i in range(WIDTH)) + " FROM cohort GROUP BY 1")
add("cohort_metadata", [LINES, COHORT], """SELECT COUNT(DISTINCT acquisition_month) AS acquisition_months, strftime(MIN(acquisition_month), '%Y-%m') AS first_acquisition_month,
  strftime(MAX(purchase_month), '%Y-%m') AS latest_purchase_month, MAX(cohort_month_index) AS max_cohort_month_index,
  strftime(MAX(purchase_month) FILTER (is_partial_period), '%Y-%m') AS partial_month FROM cohort""")
add("customer_flow", [LINES, COHORT, """fa AS (SELECT c.purchase_month AS m, COUNT(*) AS active_customers, COUNT(*) FILTER (acquisition_month = c.purchase_month) AS new_customers,
  COUNT(*) FILTER (p.customer_id IS NOT NULL) AS retained_customers, COUNT(*) FILTER (p.customer_id IS NULL AND acquisition_month < c.purchase_month) AS reactivated_customers
  FROM cm c JOIN cf ON cf.customer_id = c.customer_id LEFT JOIN cm p ON p.customer_id = c.customer_id AND p.purchase_month + INTERVAL 1 MONTH = c.purchase_month GROUP BY 1)""",
    """fl AS (SELECT CAST(p.purchase_month + INTERVAL 1 MONTH AS DATE) AS m, COUNT(*) AS lapsed_customers FROM cm p
  LEFT JOIN cm c ON p.customer_id = c.customer_id AND p.purchase_month + INTERVAL 1 MONTH = c.purchase_month WHERE c.customer_id IS NULL GROUP BY 1)"""],
    """SELECT month_start, COALESCE(active_customers, 0) AS active_customers, COALESCE(new_customers, 0) AS new_customers, COALESCE(retained_customers, 0) AS retained_customers,
  COALESCE(reactivated_customers, 0) AS reactivated_customers, COALESCE(lapsed_customers, 0) AS lapsed_customers
  FROM (SELECT CAST(UNNEST(generate_series(MIN(purchase_month), MAX(purchase_month), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM cm)
  LEFT JOIN fa ON fa.m = month_start LEFT JOIN fl ON fl.m = month_start""")
add("retention_curve", [LINES, COHORT], f"""SELECT EXTRACT(year FROM acquisition_month) AS acquisition_year, cohort_month_index, COUNT(*) AS cohorts,
  {ratio('SUM(CAST(retention_pct AS DECIMAL(9,2)))', 'COUNT(*)')} AS mean_retention_pct FROM cohort GROUP BY 1, 2""")
HOMEP = f"CASE WHEN primary_country = '{HOME}' THEN '{HOME}' ELSE 'International' END"
PEOPLE = f"people AS (SELECT *, {HOMEP} AS geography, frequency_orders >= 2 AS is_repeat FROM rfm)"
add("geo_repeat_rate", [LINES, RFM, PEOPLE], "SELECT geography, COUNT(*) AS customers, round(100 * AVG(CAST(is_repeat AS INTEGER)), 6) AS repeat_rate_pct FROM people GROUP BY 1")

# Statistics -----------------------------------------------------------------

MEASURES = ["recency_days", "frequency_orders", "monetary_value_gbp", "average_order_value_gbp", "active_span_days", "units_purchased", "distinct_products"]
ORDER_FEATURES = ["order_value", "units", "product_lines", "distinct_products"]


def ranks(name: str, source: str, columns: list[str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{shared_rank(c)} AS {c}" for c in columns) + f" FROM {source})"


def label(c: str) -> str:
    return "order_value_gbp" if c == "order_value" else c


add("spearman_pairs", [LINES, RFM, ORDER_SUMMARY, ranks("cr", "rfm", MEASURES), ranks("orr", "osum", ORDER_FEATURES)], " UNION ALL ".join(
    f"SELECT '{label(a)}' AS feature_1, '{label(b)}' AS feature_2, round(corr({a}, {b}), 6) AS rho, '{scope}' AS scope FROM {src}"
    for scope, src, cols in (("customers", "cr", MEASURES), ("orders", "orr", ORDER_FEATURES)) for a, b in combinations(cols, 2)))
add("strongest_correlations", [LINES, RFM, ranks("cr", "rfm", MEASURES), "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a} versus {b}' AS comparison, round(corr({a}, {b}), 6) AS effect FROM cr" for a, b in combinations(MEASURES, 2)) + ")"],
    f"SELECT comparison, effect AS effect_size, {MAGNITUDE} AS effect_magnitude FROM pairs ORDER BY abs(effect) DESC, comparison LIMIT 5")
add("correlation_matrix", [LINES, ORDER_SUMMARY, ranks("orr", "osum", ORDER_FEATURES)], " UNION ALL ".join(
    f"SELECT '{label(a)}' AS feature, " + ", ".join(f"{'1.0::DOUBLE' if a == b else f'round(corr({a}, {b}), 6)'} AS {label(b)}" for b in ORDER_FEATURES) + " FROM orr"
    for a in ORDER_FEATURES))


def mann_whitney(test: str, source: str, value: str, first: str) -> str:
    return f"""SELECT {big('n1')} AS n_group_1, {big('n2')} AS n_group_2, ties AS tie_term, round(r1 - n1 * (n1 + 1) / 2, 9) AS u_statistic,
  round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 9) AS rank_biserial, '{test}' AS test FROM (
  SELECT SUM(rk) FILTER (g) AS r1, {dbl('COUNT(*) FILTER (g)')} AS n1, {dbl('COUNT(*) FILTER (NOT g)')} AS n2,
  SUM(tie) AS ties FROM (SELECT {first} AS g, {shared_rank(value)} AS rk,
  power(COUNT(*) OVER (PARTITION BY {value}), 2) - 1 AS tie FROM {source}))"""


add("mann_whitney", [LINES, RFM, ORDER_SUMMARY], mann_whitney("repeat_value", "rfm", "revenue", "frequency_orders >= 2") + " UNION ALL "
    + mann_whitney("home_order_value", "osum", "order_value", f"country = '{HOME}'"))
CONT = f"""ct AS (SELECT g AS geography, COUNT(*) FILTER (geography = g AND NOT is_repeat) AS one_time_customers,
  COUNT(*) FILTER (geography = g AND is_repeat) AS repeat_customers FROM people, (VALUES ('{HOME}'), ('International')) v(g) GROUP BY g)"""
add("contingency", [LINES, RFM, PEOPLE, CONT], "SELECT * FROM ct")
add("chi_square", [LINES, RFM, PEOPLE, CONT, f"cells AS (SELECT geography, 0 AS c, {dbl('one_time_customers')} AS o FROM ct UNION ALL SELECT geography, 1, {dbl('repeat_customers')} FROM ct)",
    "e AS (SELECT o, SUM(o) OVER (PARTITION BY geography) * SUM(o) OVER (PARTITION BY c) / SUM(o) OVER () AS x FROM cells)"],
    "SELECT round(SUM((o - x) * (o - x) / x), 9) AS chi_square, round(sqrt(SUM((o - x) * (o - x) / x) / SUM(o)), 9) AS cramers_v, CAST(SUM(o) AS BIGINT) AS n FROM e")
add("group_summaries", [LINES, RFM, ORDER_SUMMARY, PEOPLE], f"""SELECT 'median_customer_value' AS measure, CASE WHEN is_repeat THEN 'repeat' ELSE 'one_time' END AS "group",
  round(quantile_cont(monetary_value_gbp, 0.5), 6) AS value FROM people GROUP BY 2
  UNION ALL SELECT 'median_order_value', {PLACE}, round(quantile_cont({dbl('order_value')}, 0.5), 6) FROM osum GROUP BY 2
  UNION ALL SELECT 'repeat_proportion', geography, round(AVG(CAST(is_repeat AS INTEGER)), 6) FROM people GROUP BY 2""")

# Tail probabilities: the t tail of whole degrees of freedom is a finite sum, erfc a
# series of positive terms, and the exact null of U the coefficients of a product.


def t_tail(t: str, v: str) -> str:
    th = f"atan(abs({t}) / sqrt({v}))"
    odd = (f"2 / pi() * ({th} + sin({th}) * COALESCE(list_sum(list_transform(range(0, CAST(({v} - 1) / 2 AS BIGINT)), "
           f"lambda j: exp(j * ln(4.0) + 2 * lgamma(j + 1) - lgamma(2 * j + 2) + (2 * j + 1) * ln(cos({th}))))), 0))")
    even = (f"sin({th}) * COALESCE(list_sum(list_transform(range(0, CAST({v} / 2 AS BIGINT)), "
            f"lambda j: exp(lgamma(2 * j + 1) - j * ln(4.0) - 2 * lgamma(j + 1) + 2 * j * ln(cos({th}))))), 0)")
    return f"GREATEST(0, 1 - CASE WHEN {v} % 2 = 1 THEN {odd} ELSE {even} END)"


def erfc(x: str) -> str:
    series = (f"list_sum(list_transform(range(0, 300), lambda j: exp(j * ln(4.0) + lgamma(j + 1) - lgamma(2 * j + 2) + (2 * j + 1) * ln({x}))))")
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 6 THEN 0.0 ELSE GREATEST(0, 1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * {series}) END"


def mann_whitney_p(name: str, source: str) -> str:
    """CTE ``name`` with u, sizes, effect and p of the one-row CTE ``source``."""
    return f"""{name}x AS (SELECT *, LEAST(n1, n2) AS small, GREATEST(n1, n2) AS large, CAST(LEAST(u, n1 * n2 - u) AS BIGINT) AS last,
    LEAST(n1, n2) BETWEEN 1 AND 8 AND ties = 0 AS exact FROM {source}),
{name}r(i, c) AS (SELECT 0, CASE WHEN exact THEN list_transform(range(0, last + 1), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END FROM {name}x
  UNION ALL SELECT i + 1, list_transform(range(0, last + 1), lambda k: list_sum(list_transform(range(0, k // (i + 1) + 1),
    lambda j: c[CAST(k - j * (i + 1) + 1 AS BIGINT)] - CASE WHEN k - j * (i + 1) - large - i - 1 >= 0 THEN c[CAST(k - j * (i + 1) - large - i AS BIGINT)] ELSE 0 END)))
  FROM {name}r, {name}x WHERE exact AND i < small),
{name} AS (SELECT *, CASE WHEN n1 = 0 OR n2 = 0 THEN NULL WHEN exact THEN LEAST(1, 2 * (SELECT list_sum(c) FROM {name}r WHERE i = small) / exp(lgamma(n1 + n2 + 1) - lgamma(small + 1) - lgamma(large + 1)))
  ELSE LEAST(1, {erfc(f"((GREATEST(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) / sqrt(2.0))")}) END AS p FROM {name}x)"""


TESTS = [LINES, RFM, ORDER_SUMMARY, PEOPLE, CONT, ranks("cr", "rfm", MEASURES), "pn AS (SELECT COUNT(*) AS n FROM rfm)",
    "sp AS (" + " UNION ALL ".join(f"SELECT 'spearman__{a}__{b}' AS test_id, corr({a}, {b}) AS rho FROM cr" for a, b in combinations(MEASURES, 2)) + ")",
    f"""sq AS (SELECT test_id, 'spearman_correlations' AS family, n AS sample_size_total, NULL::BIGINT AS sample_size_group_1, NULL::BIGINT AS sample_size_group_2, rho AS statistic, rho AS effect,
      CASE WHEN abs(rho) >= 1 THEN 0 ELSE {t_tail('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')} END AS p FROM sp, pn)""",
    "ua AS (SELECT n_group_1::DOUBLE AS n1, n_group_2::DOUBLE AS n2, tie_term::DOUBLE AS ties, u_statistic AS u FROM (" + mann_whitney("a", "rfm", "revenue", "frequency_orders >= 2") + "))",
    "ub AS (SELECT n_group_1::DOUBLE AS n1, n_group_2::DOUBLE AS n2, tie_term::DOUBLE AS ties, u_statistic AS u FROM (" + mann_whitney("b", "osum", "order_value", f"country = '{HOME}'") + "))",
    mann_whitney_p("va", "ua"), mann_whitney_p("vb", "ub"),
    f"chc AS (SELECT geography, 0 AS c, {dbl('one_time_customers')} AS o FROM ct UNION ALL SELECT geography, 1, {dbl('repeat_customers')} FROM ct)",
    "che AS (SELECT o, SUM(o) OVER (PARTITION BY geography) * SUM(o) OVER (PARTITION BY c) / SUM(o) OVER () AS x FROM chc)",
    "chs AS (SELECT CASE WHEN MIN(x) > 0 THEN SUM((o - x) * (o - x) / x) END AS x2, SUM(o) AS n FROM che)",
    f"chp AS (SELECT *, CASE WHEN x2 IS NOT NULL THEN {erfc('sqrt(x2 / 2)')} END AS p FROM chs)",
    f"""raw AS MATERIALIZED (SELECT * FROM sq
      UNION ALL SELECT 'mann_whitney__repeat_vs_one_time_customer_value', 'confirmatory_group_tests', CAST(n1 + n2 AS BIGINT), CAST(n1 AS BIGINT), CAST(n2 AS BIGINT), CASE WHEN n1 > 0 AND n2 > 0 THEN u END, CASE WHEN n1 > 0 AND n2 > 0 THEN 2 * u / (n1 * n2) - 1 END, p FROM va
      UNION ALL SELECT 'mann_whitney__home_vs_international_order_value', 'confirmatory_group_tests', CAST(n1 + n2 AS BIGINT), CAST(n1 AS BIGINT), CAST(n2 AS BIGINT), CASE WHEN n1 > 0 AND n2 > 0 THEN u END, CASE WHEN n1 > 0 AND n2 > 0 THEN 2 * u / (n1 * n2) - 1 END, p FROM vb
      UNION ALL SELECT 'chi_square__geography_vs_repeat_status', 'confirmatory_group_tests', CAST(n AS BIGINT),
        (SELECT one_time_customers + repeat_customers FROM ct WHERE geography = '{HOME}'), (SELECT one_time_customers + repeat_customers FROM ct WHERE geography = 'International'),
        x2, sqrt(x2 / n), p FROM chp)""",
    """stp AS (SELECT *, CASE WHEN p IS NOT NULL THEN LEAST(1, p * (COUNT(p) OVER (PARTITION BY family) - ROW_NUMBER() OVER (PARTITION BY family ORDER BY p NULLS LAST, test_id) + 1)) END AS st FROM raw)""",
    """adj AS (SELECT *, CASE WHEN p IS NOT NULL THEN MAX(st) OVER (PARTITION BY family ORDER BY p NULLS LAST, test_id ROWS UNBOUNDED PRECEDING) END AS q FROM stp)"""]


def tested(where: str = "TRUE") -> str:
    return f"""SELECT test_id, family, sample_size_total, sample_size_group_1, sample_size_group_2, round(statistic, 6) AS statistic, round(effect, 6) AS effect_size,
  round(p, 9) AS raw_p_value, round(q, 9) AS adjusted_p_value, {MAGNITUDE} AS effect_magnitude, q < 0.05 AS reject_null FROM adj WHERE {where}"""


add("hypothesis_tests", TESTS, tested())
add("correlation_tests", TESTS, tested("family = 'spearman_correlations'"))
for _name in ("hypothesis_tests", "correlation_tests"):
    ORACLE[_name] = ORACLE[_name].replace("WITH ", "WITH RECURSIVE ", 1)
add("statistical_summary", TESTS, """SELECT COUNT(*) AS tests, COUNT(*) FILTER (family = 'spearman_correlations') AS correlations,
  COUNT(*) FILTER (family <> 'spearman_correlations') AS confirmatory_group_tests, COUNT(*) FILTER (q < 0.05) AS holm_adjusted_significant,
  MAX(sample_size_total) FILTER (family = 'spearman_correlations') AS customers, MAX(sample_size_total) FILTER (test_id LIKE '%order_value') AS orders,
  round(MIN(effect) FILTER (family = 'spearman_correlations'), 6) AS least_correlation, round(MAX(effect) FILTER (family = 'spearman_correlations'), 6) AS greatest_correlation,
  (SELECT string_agg(test_id, ',' ORDER BY abs(effect) DESC, test_id) FROM (SELECT * FROM raw WHERE family = 'spearman_correlations' ORDER BY abs(effect) DESC, test_id LIMIT 5)) AS strongest,
  string_agg(test_id, ',' ORDER BY test_id) FILTER (family <> 'spearman_correlations') AS group_tests FROM adj""".replace("LIKE '%order_value'", "LIKE 'mann_whitney__home%'"))
ORACLE["statistical_summary"] = ORACLE["statistical_summary"].replace("WITH ", "WITH RECURSIVE ", 1)

ORACLE["published_star"] = f"""SELECT table_name, 'rows' AS rule, row_count AS failures FROM ({ORACLE['star_row_counts']})
UNION ALL SELECT table_name, rule, failures FROM ({ORACLE['constraint_report']})"""

# Clusters on fixed labels ---------------------------------------------------

CONTRACT = ["customer_id", "primary_country", "average_order_value_gbp", "active_span_days", "units_purchased", "distinct_products", "segment", *RFM_FEATURES]
add("input_contract", [LINES, RFM], " UNION ALL ".join(
    [f"SELECT '{c}_missing' AS rule, COUNT(*) FILTER ({c} IS NULL) AS failures FROM rfm" for c in CONTRACT]
    + [f"SELECT '{c}_negative', COUNT(*) FILTER ({c} < 0) FROM rfm" for c in RFM_FEATURES]
    + ["SELECT 'customer_id_unique', COUNT(*) - COUNT(DISTINCT customer_id) FROM rfm"]))
LOGGED = "lg AS (SELECT *, " + ", ".join(f"ln(1 + {dbl(c)}) AS l{i}" for i, c in enumerate(RFM_FEATURES)) + " FROM rfm)"
SCALED = ("mo AS (SELECT " + ", ".join(f"AVG(l{i}) AS m{i}, STDDEV_POP(l{i}) AS s{i}" for i in range(3)) + " FROM lg),\n"
          "sc AS MATERIALIZED (SELECT lg.*, " + ", ".join(f"(l{i} - m{i}) / s{i} AS x{i}" for i in range(3)) + ", "
          + ", ".join(f"{qbin(f'ROW_NUMBER() OVER (ORDER BY {c} DESC, customer_id)', 'n', k)} AS {name}_{k}"
                      for k in (2, 3, 4) for name, c in (("by_value", "revenue"), ("by_units", "units_purchased"), ("by_orders", "frequency_orders")))
          + " FROM lg, mo),\ncl AS (SELECT *, by_value_4 AS cluster_id FROM sc)")
CLUSTERS = [LINES, RFM, LOGGED, SCALED]
add("scaled_features", CLUSTERS, "SELECT customer_id, " + ", ".join(f"round(x{i}, 6) AS z_{c}" for i, c in enumerate(RFM_FEATURES)) + " FROM sc")


def quality(p: str, labels: str) -> str:
    """CTEs <p>ch, <p>db, <p>sq over sc with one label column."""
    cents = ", ".join(f"AVG(x{i}) AS c{i}" for i in range(3))
    d2 = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in range(3))
    off = " + ".join(f"(c{i} - g{i}) * (c{i} - g{i})" for i in range(3))
    apart = " + ".join(f"(a.c{i} - b.c{i}) * (a.c{i} - b.c{i})" for i in range(3))
    norm = " + ".join(f"x{i} * x{i}" for i in range(3))
    dot = " + ".join(f"x{i} * c{i}" for i in range(3))
    return f"""{p}c AS (SELECT {labels} AS lab, COUNT(*) AS cn, {cents}, AVG({norm}) AS nn FROM sc GROUP BY 1),
{p}g AS (SELECT {', '.join(f'AVG(x{i}) AS g{i}' for i in range(3))} FROM sc),
{p}d AS (SELECT lab, {d2} AS d2 FROM sc JOIN {p}c ON {labels} = lab),
{p}w AS (SELECT SUM(d2) AS w FROM {p}d), {p}b AS (SELECT SUM(cn * ({off})) AS b, SUM(cn) AS n, COUNT(*) AS k, MIN(cn) AS smallest FROM {p}c, {p}g),
{p}ch AS (SELECT CAST(k AS INTEGER) AS k, w AS inertia, b * (n - k) / (w * (k - 1)) AS ch, CAST(smallest AS BIGINT) AS smallest, 100.0 * smallest / n AS share FROM {p}w, {p}b),
{p}s AS (SELECT lab, AVG(sqrt(d2)) AS s FROM {p}d GROUP BY lab),
{p}db AS (SELECT AVG(worst) AS db FROM (SELECT a.lab, MAX((sa.s + sb.s) / sqrt({apart})) AS worst FROM {p}c a JOIN {p}c b ON a.lab <> b.lab
  JOIN {p}s sa ON sa.lab = a.lab JOIN {p}s sb ON sb.lab = b.lab GROUP BY a.lab)),
{p}m AS (SELECT customer_id, {labels} AS own, lab, cn, ({norm}) - 2 * ({dot}) + nn AS md FROM sc, {p}c),
{p}p AS (SELECT customer_id, MAX(md * cn / NULLIF(cn - 1, 0)) FILTER (lab = own) AS a, MAX(cn) FILTER (lab = own) AS size, MIN(md) FILTER (lab <> own) AS b FROM {p}m GROUP BY customer_id),
{p}sq AS (SELECT AVG(CASE WHEN size = 1 THEN 0 ELSE (b - a) / GREATEST(a, b) END) AS sq FROM {p}p)"""


def rand_index(name: str, a: str, b: str) -> str:
    two = "n * (n - 1) / 2.0::DOUBLE"
    return f"""SELECT '{name}' AS pair, (ij - a * b / t) / ((a + b) / 2 - a * b / t) AS ari FROM
  (SELECT SUM({two}) AS ij FROM (SELECT COUNT(*)::DOUBLE AS n FROM sc GROUP BY {a}, {b})), (SELECT SUM({two}) AS a FROM (SELECT COUNT(*)::DOUBLE AS n FROM sc GROUP BY {a})),
  (SELECT SUM({two}) AS b FROM (SELECT COUNT(*)::DOUBLE AS n FROM sc GROUP BY {b})), (SELECT {two} AS t FROM (SELECT COUNT(*)::DOUBLE AS n FROM sc))"""


add("calinski_harabasz", [*CLUSTERS, quality("q", "by_value_4")], "SELECT k, round(inertia, 5) AS inertia, round(ch, 5) AS calinski_harabasz_score, smallest AS minimum_cluster_count, round(share, 5) AS minimum_cluster_share_pct FROM qch")
add("davies_bouldin", [*CLUSTERS, quality("q", "by_value_4")], "SELECT round(db, 6) AS davies_bouldin_score FROM qdb")
add("silhouette_squared", [*CLUSTERS, quality("q", "by_value_4")], "SELECT round(sq, 6) AS silhouette_score FROM qsq")
add("silhouette", [*CLUSTERS, """pd AS (SELECT a.customer_id, a.cluster_id AS own, b.cluster_id AS lab, SUM(sqrt("""
    + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(3)) + """)) AS t, COUNT(*) AS n FROM cl a, cl b GROUP BY 1, 2, 3)""",
    """pp AS (SELECT customer_id, MAX(t / NULLIF(n - 1, 0)) FILTER (lab = own) AS a, MAX(n) FILTER (lab = own) AS size, MIN(t / n) FILTER (lab <> own) AS b FROM pd GROUP BY 1)"""],
    "SELECT round(AVG(CASE WHEN size = 1 THEN 0 ELSE (b - a) / GREATEST(a, b) END), 6) AS silhouette_score FROM pp")
add("adjusted_rand", CLUSTERS, " UNION ALL ".join(
    f"""SELECT '{a}' AS "left", '{b}' AS "right", round(ari, 9) AS adjusted_rand FROM ({rand_index('x', a, b)})"""
    for a, b in combinations(["by_value_4", "by_units_4", "by_orders_4"], 2)))
KS = range(2, 11)
_PLACES = ("all", "place_a"), ("most", "place_m"), ("many", "place_n")
BINS = ("vp AS (SELECT sc.*, ROW_NUMBER() OVER (ORDER BY revenue DESC, customer_id) AS place_a, n + 1 - ROW_NUMBER() OVER (ORDER BY revenue, customer_id) AS place_m FROM sc),\n"
        "vq AS (SELECT *, GREATEST(1, LEAST(n, place_a + CASE WHEN place_a % 2 = 0 THEN 1 ELSE -1 END)) AS place_n FROM vp),\n"
        "vb AS MATERIALIZED (SELECT *, " + ", ".join(f"{qbin(p, 'n', k)} AS {name}_{k}" for k in KS for name, p in _PLACES) + " FROM vq)")
BINNED = [LINES, RFM, LOGGED, SCALED.replace("sc AS", "sc0 AS").replace("FROM sc)", "FROM sc0)"),
          BINS.replace("sc.*", "sc0.*").replace("FROM sc)", "FROM sc0)"), "sc AS (SELECT * FROM vb)"]
EVALUATION = "ev AS (" + " UNION ALL ".join(
    f"""SELECT {k} AS k, sq AS sil, ch, db, share, (SELECT AVG(ari) FROM ({' UNION ALL '.join(rand_index(f'{a}{b}', f'{a}_{k}', f'{b}_{k}')
    for a, b in combinations(['all', 'most', 'many'], 2))})) AS ari FROM z{k}ch, z{k}db, z{k}sq""" for k in KS) + ")"
add("k_selection", [*BINNED, *[quality(f"z{k}", f"all_{k}") for k in KS], EVALUATION,
    "el AS (SELECT *, COALESCE(share >= 2 AND ari >= 0.80, FALSE) AS eligible FROM ev)",
    """rk AS (SELECT *, CASE WHEN eligible THEN RANK() OVER (PARTITION BY eligible ORDER BY sil DESC) END AS r1,
      CASE WHEN eligible THEN RANK() OVER (PARTITION BY eligible ORDER BY ch DESC) END AS r2, CASE WHEN eligible THEN RANK() OVER (PARTITION BY eligible ORDER BY db) END AS r3,
      CASE WHEN eligible THEN RANK() OVER (PARTITION BY eligible ORDER BY ari DESC) END AS r4 FROM el)"""],
    """SELECT k, round(sil, 5) AS silhouette_score, round(ch, 5) AS calinski_harabasz_score, round(db, 5) AS davies_bouldin_score, round(share, 5) AS minimum_cluster_share_pct,
  round(ari, 5) AS mean_pairwise_ari, eligible, r1 AS rank_silhouette, r2 AS rank_calinski_harabasz, r3 AS rank_davies_bouldin, r4 AS rank_stability,
  r1 + r2 + r3 + r4 AS selection_rank_sum, eligible AND ROW_NUMBER() OVER (PARTITION BY eligible ORDER BY r1 + r2 + r3 + r4, sil DESC, db, k) = 1 AS metric_optimal FROM rk""")

# Fits have no SQL form; what must hold of any fit has.
PEOPLE_COUNT = "(SELECT COUNT(*) FROM rfm)"
add("kmeans_assign", [LINES, RFM], f"SELECT {PEOPLE_COUNT} AS customers, {PEOPLE_COUNT} AS distinct_customers, 4 AS clusters, 0 AS not_nearest, 0 AS order_violations")
STATED = ("sp AS (SELECT *, (x1 + x2 - x0) / 3 AS p FROM sc0),\nsc AS MATERIALIZED (SELECT *, " + ", ".join(
    f"LEAST({k - 1}, GREATEST(0, CAST(floor((p - ({-1.5 + 1.5 / k + 0.02 * i!r})) / {3 / k!r} + 0.5) AS INTEGER))) AS st{i}_{k}"
    for k in KS for i in range(5)) + " FROM sp)")
APART = "ap AS MATERIALIZED (SELECT a.customer_id AS u, b.customer_id AS v, sqrt(" + " + ".join(
    f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(3)) + ") AS d FROM sc a, sc b)"


def euclidean(k: int) -> str:
    """CTEs for the mean Euclidean silhouette of the first stated labelling with k centres."""
    lab = f"st0_{k}"
    return f"""e{k}n AS (SELECT {lab} AS lab, COUNT(*) AS size FROM sc GROUP BY 1),
e{k}s AS (SELECT u, {lab} AS lab, SUM(d) AS t FROM ap JOIN sc ON customer_id = v GROUP BY 1, 2),
e{k}p AS (SELECT u, MAX(t / NULLIF(c.size - 1, 0)) FILTER (s.lab = {lab}) AS a, MAX(c.size) FILTER (s.lab = {lab}) AS size, MIN(t / c.size) FILTER (s.lab <> {lab}) AS b
  FROM e{k}s s JOIN e{k}n c ON c.lab = s.lab JOIN sc ON customer_id = u GROUP BY u),
e{k} AS (SELECT AVG(CASE WHEN size = 1 THEN 0 ELSE COALESCE((b - a) / GREATEST(a, b), 0) END) AS sil FROM e{k}p)"""


SCORES = "sv AS (" + " UNION ALL ".join(
    f"""SELECT {k} AS k, q.inertia, sil, ch, db, smallest, share, r.mean_ari, r.least_ari FROM (SELECT * FROM y{k}ch) q, y{k}db, e{k},
  (SELECT AVG(ari) AS mean_ari, MIN(ari) AS least_ari FROM ({' UNION ALL '.join(rand_index(f'{a}{b}', f'st{a}_{k}', f'st{b}_{k}') for a, b in combinations(range(5), 2))})) r"""
    for k in KS) + (
    "), ss AS (SELECT *, 100 * (LAG(inertia) OVER (ORDER BY k) - inertia) / LAG(inertia) OVER (ORDER BY k) AS falls, "
    "COALESCE(share >= 2 AND mean_ari >= 0.80, FALSE) AS eligible FROM sv)")
STATED_SCORES = [LINES, RFM, LOGGED, SCALED.replace("sc AS", "sc0 AS").replace("FROM sc)", "FROM sc0)"), STATED, APART,
                 *[quality(f"y{k}", f"st0_{k}") for k in KS], *[euclidean(k) for k in KS], SCORES]
add("k_scores", [*STATED_SCORES,
    """sr AS (SELECT *, CASE WHEN eligible THEN RANK() OVER (PARTITION BY eligible ORDER BY sil DESC) END AS r1,
      CASE WHEN eligible THEN RANK() OVER (PARTITION BY eligible ORDER BY ch DESC) END AS r2, CASE WHEN eligible THEN RANK() OVER (PARTITION BY eligible ORDER BY db) END AS r3,
      CASE WHEN eligible THEN RANK() OVER (PARTITION BY eligible ORDER BY mean_ari DESC) END AS r4 FROM ss)"""],
    """SELECT k, round(inertia, 5) AS inertia, round(falls, 5) AS inertia_reduction_from_previous_k_pct, round(sil, 5) AS silhouette_score, round(ch, 5) AS calinski_harabasz_score,
  round(db, 5) AS davies_bouldin_score, smallest AS minimum_cluster_count, round(share, 5) AS minimum_cluster_share_pct, round(mean_ari, 5) AS mean_pairwise_ari,
  round(least_ari, 5) AS minimum_pairwise_ari, 5 AS stability_seed_count, 10 AS stability_pair_count, 'euclidean' AS silhouette_distance, 42 AS seed, eligible,
  r1 AS rank_silhouette, r2 AS rank_calinski_harabasz, r3 AS rank_davies_bouldin, r4 AS rank_stability, r1 + r2 + r3 + r4 AS selection_rank_sum,
  eligible AND ROW_NUMBER() OVER (PARTITION BY eligible ORDER BY r1 + r2 + r3 + r4, sil DESC, db, k) = 1 AS metric_optimal FROM sr""")
add("k_evaluation", STATED_SCORES, """SELECT k, 5 AS stability_seed_count, 10 AS stability_pair_count, 'euclidean' AS silhouette_distance, 42 AS seed, TRUE AS inertia_falls,
  TRUE AS scores_in_range, TRUE AS share_agrees, TRUE AS gates_agree, TRUE AS only_eligible_ranked, TRUE AS cheaper_than_stated, round(inertia, 5) AS stated_inertia,
  round(sil, 5) AS stated_silhouette_score, round(mean_ari, 5) AS stated_mean_pairwise_ari, smallest AS stated_minimum_cluster_count FROM ss""")
add("k_metrics", [LINES, RFM], f"SELECT {PEOPLE_COUNT} AS customers, 4 AS clusters, TRUE AS calinski_harabasz, TRUE AS inertia, TRUE AS smallest, TRUE AS adjusted_rand")
add("cluster_gates", [LINES, RFM], """SELECT gate, CAST(actual AS DOUBLE) AS actual, TRUE AS passed FROM (
  SELECT 'customer_count' AS gate, COUNT(*)::DOUBLE AS actual FROM rfm
  UNION ALL SELECT 'missing_clustering_features', COUNT(*) FILTER (recency_days IS NULL OR frequency_orders IS NULL OR monetary_value_gbp IS NULL) FROM rfm
  UNION ALL SELECT 'one_assignment_per_customer', COUNT(*) - COUNT(DISTINCT customer_id) FROM rfm
  UNION ALL SELECT 'cluster_counts_reconcile', COUNT(*) FROM rfm
  UNION ALL SELECT 'recorded_seed', 42
  UNION ALL SELECT 'monetary_value_reconciliation', CAST(SUM(revenue) AS DOUBLE) FROM rfm
  UNION ALL SELECT unnest(['metric_optimal_benchmark', 'final_clusters', 'stability_metrics', 'minimum_cluster_share', 'business_labels']), NULL)""")
add("build_clusters", [LINES, RFM], f"""SELECT COUNT(*) AS customers, {dbl('SUM(revenue)')} AS value, COUNT(*) AS profiled_customers, TRUE AS profiles_are_k,
  COUNT(*) AS crossed_customers, TRUE AS crosstab_is_full, 9 AS candidates, 1 AS chosen FROM rfm""")

# Principal components of the three scaled features: eigenvalues of their symmetric
# matrix in closed form, eigenvectors as cross products.
PCA = f"""mm AS (SELECT VAR_SAMP(x0) AS a, VAR_SAMP(x1) AS b, VAR_SAMP(x2) AS c, COVAR_SAMP(x0, x1) AS d, COVAR_SAMP(x0, x2) AS e, COVAR_SAMP(x1, x2) AS f FROM sc),
mq AS (SELECT *, (a + b + c) / 3 AS q, sqrt((power(a - (a + b + c) / 3, 2) + power(b - (a + b + c) / 3, 2) + power(c - (a + b + c) / 3, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM mm),
mr AS (SELECT *, LEAST(1, GREATEST(-1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p))) AS r FROM mq),
ml AS (SELECT *, q + 2 * p * cos(acos(r) / 3) AS l1, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l3 FROM mr),
me AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM ml),
mv AS (SELECT i, l, l / (3 * q) AS share, d * f - e * (b - l) AS v0, e * d - (a - l) * f AS v1, (a - l) * (b - l) - d * d AS v2
  FROM (SELECT *, 1 AS i, l1 AS l FROM me UNION ALL SELECT *, 2 AS i, l2 AS l FROM me)),
mu AS (SELECT i, share, v0 / sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS v0, v1 / sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS v1, v2 / sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS v2 FROM mv)"""
add("pca_projection", [*CLUSTERS, PCA], "SELECT customer_id, " + ", ".join(
    f"round(abs(x0 * u{i}.v0 + x1 * u{i}.v1 + x2 * u{i}.v2), 5) AS component_{i}, round(100 * u{i}.share, 5) AS explained_pct_{i}" for i in (1, 2))
    + " FROM sc, (SELECT * FROM mu WHERE i = 1) u1, (SELECT * FROM mu WHERE i = 2) u2")
DOMINANT = f"""dm AS (SELECT cluster_id, segment AS dominant_rfm_segment, {ratio('c', 'n', 100)} AS dominant_rfm_segment_share_pct FROM (
  SELECT cluster_id, segment, COUNT(*) AS c, SUM(COUNT(*)) OVER (PARTITION BY cluster_id) AS n,
  ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY COUNT(*) DESC, segment) AS rn FROM cl GROUP BY cluster_id, segment) WHERE rn = 1)"""
add("dominant_segment", [*CLUSTERS, DOMINANT], "SELECT * FROM dm")


def med(c: str) -> str:
    return f"quantile_cont({dbl(c)}, 0.5)"


PROFILES = f"""ct AS (SELECT COUNT(*) AS tn, SUM(revenue) AS tv FROM cl),
cp AS (SELECT cluster_id, COUNT(*) AS customer_count, {ratio('COUNT(*)', 'ANY_VALUE(tn)', 100)} AS customer_share_pct, {dbl('SUM(revenue)')} AS total_monetary_value_gbp,
  {ratio('SUM(revenue)', 'ANY_VALUE(tv)', 100)} AS revenue_share_pct, {med('recency_days')} AS median_recency_days, {ratio('SUM(recency_days)', 'COUNT(*)')} AS average_recency_days,
  {med('frequency_orders')} AS median_frequency_orders, {ratio('SUM(frequency_orders)', 'COUNT(*)')} AS average_frequency_orders, {med('monetary_value_gbp')} AS median_monetary_value_gbp,
  {ratio('SUM(revenue)', 'COUNT(*)')} AS average_monetary_value_gbp, AVG(average_order_value_gbp) AS average_order_value_gbp, {med('active_span_days')} AS median_active_span_days,
  {big('SUM(units_purchased)')} AS total_units_purchased, {med('distinct_products')} AS median_distinct_products,
  {ratio('COUNT(*) FILTER (frequency_orders >= 2)', 'COUNT(*)', 100)} AS repeat_customer_rate_pct,
  {ratio(f"COUNT(*) FILTER (primary_country = '{HOME}')", 'COUNT(*)', 100)} AS home_customer_share_pct FROM cl, ct GROUP BY cluster_id),
prof AS (SELECT * FROM cp JOIN dm USING (cluster_id))"""
PROFILE_DOUBLES = ["customer_share_pct", "total_monetary_value_gbp", "revenue_share_pct", "median_recency_days", "average_recency_days", "median_frequency_orders",
                   "average_frequency_orders", "median_monetary_value_gbp", "average_monetary_value_gbp", "average_order_value_gbp", "median_active_span_days",
                   "median_distinct_products", "repeat_customer_rate_pct", "home_customer_share_pct", "dominant_rfm_segment_share_pct"]
add("cluster_profiles", [*CLUSTERS, DOMINANT, PROFILES], "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in PROFILE_DOUBLES) + ") FROM prof")
def cases(column: str, values: dict[int, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


LABELLED = f"""lr AS (SELECT *, ROW_NUMBER() OVER (ORDER BY median_recency_days, cluster_id) AS rr, ROW_NUMBER() OVER (ORDER BY median_frequency_orders DESC, cluster_id) AS rf,
  ROW_NUMBER() OVER (ORDER BY median_monetary_value_gbp DESC, cluster_id) AS rm FROM prof),
lb AS (SELECT cluster_id, {cases('cluster_id', LABELS)} AS cluster_label,
  format('Median recency={{:.1f}} days (rank {{}}/4); frequency={{:.1f}} orders (rank {{}}/4); monetary value=GBP {{}} (rank {{}}/4).',
    median_recency_days, rr, median_frequency_orders, rf, format('{{:,.2f}}', median_monetary_value_gbp), rm) AS label_basis,
  {cases('rr', ACTIONS_BY_RECENCY)} AS recommended_action FROM lr)"""
add("cluster_labels", [*CLUSTERS, DOMINANT, PROFILES, LABELLED], "SELECT * FROM lb")
add("cluster_mart", [*CLUSTERS, DOMINANT, PROFILES, LABELLED], """SELECT cluster_id, cluster_label, customer_count, round(customer_share_pct, 6) AS customer_share_pct,
  round(total_monetary_value_gbp, 6) AS historical_customer_value_gbp, round(revenue_share_pct, 6) AS historical_value_share_pct, round(median_recency_days, 6) AS median_recency_days,
  round(median_frequency_orders, 6) AS median_frequency_orders, round(median_monetary_value_gbp, 6) AS median_monetary_value_gbp, round(repeat_customer_rate_pct, 6) AS repeat_customer_rate_pct,
  dominant_rfm_segment, round(dominant_rfm_segment_share_pct, 6) AS dominant_rfm_segment_share_pct, label_basis, recommended_action FROM prof JOIN lb USING (cluster_id)""")
add("segment_cluster_crosstab", [*CLUSTERS, PLAN, """xt AS (SELECT segment AS rfm_segment, c.cluster_id, (SELECT COUNT(*) FROM cl WHERE cl.segment = plan.segment AND cl.cluster_id = c.cluster_id) AS customer_count
  FROM plan, (SELECT DISTINCT cluster_id FROM cl) c)"""], f"""SELECT rfm_segment, cluster_id, customer_count,
  {ratio('customer_count', 'SUM(customer_count) OVER (PARTITION BY rfm_segment)', 100)} AS share_of_rfm_segment_pct,
  {ratio('customer_count', 'SUM(customer_count) OVER (PARTITION BY cluster_id)', 100)} AS share_of_cluster_pct FROM xt""")

# Marts ----------------------------------------------------------------------

add("calendar", [LINES, """e AS (SELECT CAST(MIN(invoice_date) AS DATE) AS lo, CAST(MAX(invoice_date) AS DATE) AS hi FROM sales)""",
    "d AS (SELECT CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date, hi FROM e)"], """SELECT date, EXTRACT(year FROM date) AS year,
  EXTRACT(quarter FROM date) AS quarter, EXTRACT(month FROM date) AS month_number, monthname(date) AS month_name, strftime(date, '%Y-%m') AS year_month,
  CAST(date_trunc('month', date) AS DATE) AS month_start, strftime(date, '%Y-%m') = strftime(hi, '%Y-%m') AND hi < last_day(hi) AS is_partial_period FROM d""")
ORDER_FACT = f"""of AS (SELECT invoice_no AS order_id, CAST(invoice_date AS DATE) AS order_date, CAST(date_trunc('month', invoice_date) AS DATE) AS month_start, customer_id, country,
  {dbl('order_value')} AS order_revenue_gbp, units AS units_sold, distinct_products, product_lines AS line_count, customer_id IS NOT NULL AS is_identified_customer FROM osum)"""
add("order_fact", [LINES, ORDER_SUMMARY, ORDER_FACT], "SELECT * FROM of")
DIMC = f"""dc AS (SELECT customer_id, CAST(first_purchase AS DATE) AS first_purchase_date, CAST(last_purchase AS DATE) AS last_purchase_date, recency_days, frequency_orders, monetary_value_gbp,
  average_order_value_gbp, units_purchased, distinct_products, frequency_orders >= 2 AS is_repeat_customer, r_score, f_score, m_score, rfm_score, segment AS rfm_segment, cluster_id,
  {cases('cluster_id', LABELS)} AS cluster_label FROM cl)"""
add("dim_customer_mart", [*CLUSTERS, DIMC], "SELECT * FROM dc")
add("product_month", [LINES], f"""SELECT month_start, stock_code, arg_max(COALESCE(description, 'Unknown product'), (invoice_date, COALESCE(description, 'Unknown product'))) AS description,
  {dbl('SUM(line_revenue)')} AS revenue_gbp, {big('SUM(quantity)')} AS units_sold, COUNT(DISTINCT invoice_no) AS orders, COUNT(DISTINCT customer_id) AS identified_customers
  FROM sales GROUP BY month_start, stock_code""")
add("country_month", [LINES], f"""SELECT month_start, country, {dbl('SUM(line_revenue)')} AS revenue_gbp, COUNT(DISTINCT invoice_no) AS orders, {big('SUM(quantity)')} AS units_sold,
  COUNT(DISTINCT customer_id) AS identified_customers FROM sales GROUP BY month_start, country""")
RM = f"""rmon AS (SELECT month_start, {dbl('SUM(line_revenue)')} AS signed_return_value_gbp, {dbl('abs(SUM(line_revenue))')} AS absolute_return_value_gbp, COUNT(*) AS return_lines,
  {big('SUM(abs(quantity))')} AS returned_units FROM returns GROUP BY month_start)"""
add("returns_month", [LINES, RM], "SELECT * FROM rmon")
add("previous_month_revenue", [LINES, ORDER_SUMMARY, RM, "m AS (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month_start, SUM(order_value) AS r FROM osum GROUP BY 1)"],
    f"""SELECT m.month_start, {dbl('m.r')} AS total_revenue, {dbl('p.r')} AS previous_month_revenue, {ratio('m.r - p.r', 'p.r')} AS month_over_month_growth,
  absolute_return_value_gbp AS return_value, absolute_return_value_gbp / {dbl('m.r')} AS return_value_to_sales_ratio
  FROM m LEFT JOIN m p ON m.month_start = p.month_start + INTERVAL 1 MONTH LEFT JOIN rmon ON rmon.month_start = m.month_start""")
SALES_MEASURES = f"""{dbl('SUM(order_value)')} AS total_revenue, COUNT(*) AS total_orders, {big('SUM(units)')} AS units_sold,
  {ratio('SUM(order_value)', 'COUNT(*)')} AS average_order_value, COUNT(DISTINCT customer_id) AS identified_customers,
  {dbl('SUM(CASE WHEN customer_id IS NULL THEN order_value ELSE 0 END)')} AS anonymous_revenue,
  {ratio('SUM(CASE WHEN customer_id IS NULL THEN order_value ELSE 0 END)', 'SUM(order_value)')} AS anonymous_revenue_share"""
add("measures_by_place", [LINES, ORDER_SUMMARY], f"SELECT EXTRACT(year FROM invoice_date) AS year, country, {SALES_MEASURES} FROM osum GROUP BY 1, 2")
_GROUPED = ", ".join(f"CASE WHEN GROUPING({d}) = 0 THEN '{n}' END" for d, n in (("yr", "year"), ("country", "country"), ("seg", "rfm_segment")))
add("measures_any_slice", [LINES, ORDER_SUMMARY, RFM, """os AS (SELECT osum.*, CAST(EXTRACT(year FROM invoice_date) AS INTEGER) AS yr, segment AS seg, r.frequency_orders AS freq
  FROM osum LEFT JOIN (SELECT customer_id, segment, frequency_orders FROM rfm) r ON r.customer_id = osum.customer_id)"""],
    f"""SELECT concat_ws(',', {_GROUPED}) AS grouped_by, yr AS year, country, seg AS rfm_segment, {SALES_MEASURES},
  COUNT(DISTINCT customer_id) FILTER (freq >= 2) AS repeat_customers, {ratio('COUNT(DISTINCT customer_id) FILTER (freq >= 2)', 'COUNT(DISTINCT customer_id)')} AS repeat_customer_rate
  FROM os GROUP BY CUBE (yr, country, seg)""")
add("measures_by_slice", [LINES, ORDER_SUMMARY, RFM, f"""sm AS (SELECT segment AS rfm_segment, frequency_orders >= 2 AS is_repeat_customer, {SALES_MEASURES}
  FROM osum LEFT JOIN (SELECT customer_id, segment, frequency_orders FROM rfm) USING (customer_id) GROUP BY 1, 2)""",
    f"""pm AS (SELECT segment AS rfm_segment, frequency_orders >= 2 AS is_repeat_customer, COUNT(*) AS customers, COUNT(*) FILTER (frequency_orders >= 2) AS repeat_customers,
  COUNT(*) FILTER (segment = 'At Risk') AS at_risk_customers, {dbl('SUM(revenue)')} AS historical_customer_value FROM rfm GROUP BY 1, 2)"""],
    f"""SELECT sm.*, customers, repeat_customers, at_risk_customers, historical_customer_value, {ratio('repeat_customers', 'customers')} AS repeat_customer_rate
  FROM sm LEFT JOIN pm ON sm.rfm_segment IS NOT DISTINCT FROM pm.rfm_segment AND sm.is_repeat_customer IS NOT DISTINCT FROM pm.is_repeat_customer""")
add("customer_detail", [*CLUSTERS, ORDER_SUMMARY, ORDER_FACT, DIMC], """SELECT of.customer_id, order_id, order_date, country, order_revenue_gbp, units_sold, of.distinct_products, first_purchase_date,
  last_purchase_date, monetary_value_gbp AS historical_customer_value, frequency_orders, average_order_value_gbp, rfm_segment, cluster_label FROM of JOIN dc USING (customer_id)""")
MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]
add("product_month_matrix", [LINES, "best AS (SELECT stock_code FROM sales GROUP BY 1 ORDER BY SUM(line_revenue) DESC, stock_code LIMIT 15)"],
    "SELECT stock_code, " + ", ".join(f"""{dbl(f"SUM(line_revenue) FILTER (year_month = '{m}')")} AS "{m}" """ for m in MONTHS) + " FROM sales JOIN best USING (stock_code) GROUP BY 1")

add("scan_files", [TXN, SCANNED], f"""SELECT source_batch, COUNT(*) AS row_count, COUNT(*) AS positions, 0 AS first, COUNT(*) - 1 AS last,
  {dbl('SUM(quantity)')} AS quantity_total, {dbl('SUM(unit_price)')} AS price_total FROM scanned GROUP BY source_batch""")
add("json_roundtrip", [LINES], f"SELECT country, COUNT(*) AS row_count, {dbl('SUM(line_revenue)')} AS value FROM lines GROUP BY country")
add("export_sizes", [], """SELECT * FROM (VALUES ('without_limit', 2, 1, TRUE, TRUE), ('limit_of_one_byte', 2, 1, TRUE, FALSE))
  v(report, tables, totals, adds_up, all_passed)""")
add("small_n_scores", [LINES, "nv AS (SELECT n_name AS name, r_regionkey, r_name, SUM(line_revenue) AS v FROM lines JOIN nation ON country = n_name JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)",
    "sv AS (SELECT 'nation' AS scope, name, v FROM nv UNION ALL SELECT 'region', r_name, SUM(v) FROM nv WHERE r_regionkey < 3 GROUP BY r_name)",
    "pv AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY scope ORDER BY v, name) AS i, COUNT(*) OVER (PARTITION BY scope) AS n FROM sv)"],
    f"SELECT scope, name, CAST(CASE WHEN n >= 5 THEN {qbin('i', 'n', 5)} ELSE LEAST(5, GREATEST(1, ceil(i * 5.0 / n))) END AS INTEGER) AS score FROM pv")
add("filtered_measures", [LINES, ORDER_SUMMARY], f"""SELECT CAST(EXTRACT(year FROM invoice_date) AS INTEGER) AS year, country, {SALES_MEASURES} FROM osum
  WHERE country IN ('NATION_1', 'NATION_7') AND EXTRACT(year FROM invoice_date) BETWEEN 1996 AND 1998 GROUP BY 1, 2""")
add("product_trend", [LINES], f"""SELECT stock_code, month_start, {dbl('SUM(line_revenue)')} AS revenue_gbp, {big('SUM(quantity)')} AS units_sold
  FROM sales WHERE stock_code IN ('P1', 'P7') GROUP BY 1, 2""")
add("country_trend", [LINES], f"""SELECT country, month_start, {dbl('SUM(line_revenue)')} AS revenue_gbp, {big('SUM(quantity)')} AS units_sold
  FROM sales GROUP BY 1, 2""")

# Gates ----------------------------------------------------------------------


def failures(source: str, scope: str, batches: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS failure, '{scope}' AS scope FROM {source} HAVING {bad}" for name, bad in (
        ("no_rows", "COUNT(*) = 0"), ("no_parsed_invoice_dates", "COUNT(invoice_date) = 0"), ("no_invoice_numbers", "COUNT(invoice_no) = 0"),
        ("no_product_codes", "COUNT(stock_code) = 0"), ("no_completed_sales", "COUNT(*) FILTER (is_completed_sale) = 0"), ("too_few_batches", f"{batches} < 2")))


add("minimum_contract", [TXN, f"f AS (SELECT *, {FLAGS} FROM txn)", "lone AS (SELECT * FROM f WHERE invoice_no LIKE 'C%')"],
    failures("f", "all_lines", f"COUNT(DISTINCT load_seq // {SHIFT})") + " UNION ALL " + failures("lone", "returns_as_one_batch", "1"))


def gate(name: str, actual: str, expected: str | None, passed: str = "") -> str:
    if expected is None:
        return f"SELECT '{name}' AS gate, round({dbl(actual)}, 4) AS actual, NULL::DOUBLE AS expected, TRUE AS passed"
    return f"SELECT '{name}' AS gate, round({dbl(actual)}, 4) AS actual, round({dbl(expected)}, 4) AS expected, {passed or f'({actual}) = ({expected})'} AS passed"


N_RFM = "(SELECT COUNT(*) FROM rfm)"
V_RFM = "(SELECT SUM(revenue) FROM rfm)"
MISSING = "(SELECT COUNT(*) FROM rfm WHERE " + " OR ".join(f"{c} IS NULL" for c in MEASURES) + ")"
BAD_CELLS = "(SELECT COUNT(*) FROM cohort WHERE retention_pct NOT BETWEEN 0 AND 100)"
add("customer_gates", [LINES, RFM, COHORT], " UNION ALL ".join([
    gate("customer_count", N_RFM, None), gate("duplicate_customer_ids", "(SELECT COUNT(*) - COUNT(DISTINCT customer_id) FROM rfm)", "0"),
    gate("missing_rfm_values", MISSING, "0"), gate("segment_counts_reconcile", "(SELECT COUNT(segment) FROM rfm)", N_RFM),
    gate("monetary_value_reconciliation", V_RFM, None), gate("cohort_retention_bounds", BAD_CELLS, "0")]))
add("stat_gates", [LINES, RFM, ORDER_SUMMARY], " UNION ALL ".join([
    gate("customer_count", N_RFM, None), gate("missing_analysis_values", MISSING, "0"),
    gate("duplicate_orders", "(SELECT COUNT(*) - COUNT(DISTINCT invoice_no) FROM osum)", "0"), gate("monetary_value_reconciliation", V_RFM, None)]))
TOTAL, UNITS = "(SELECT SUM(line_revenue) FROM sales)", "(SELECT SUM(quantity) FROM sales)"
FLAGGED_DAYS = "(SELECT CASE WHEN d < last_day(d) THEN EXTRACT(day FROM d) ELSE 0 END FROM (SELECT CAST(MAX(invoice_date) AS DATE) AS d FROM sales))"
add("mart_gates", [LINES, RFM, ORDER_SUMMARY, COHORT], " UNION ALL ".join([
    gate("completed_revenue", TOTAL, None), gate("completed_orders", "(SELECT COUNT(*) FROM osum)", None), gate("completed_units", UNITS, None),
    gate("identified_customers", N_RFM, None), gate("repeat_customers", "(SELECT COUNT(*) FROM rfm WHERE frequency_orders >= 2)", None),
    gate("identified_customer_revenue", V_RFM, None), gate("signed_returns_value", "(SELECT SUM(line_revenue) FROM returns)", None),
    gate("segment_totals", N_RFM, N_RFM), gate("cluster_totals", N_RFM, N_RFM),
    gate("duplicate_order_ids", "(SELECT COUNT(*) - COUNT(DISTINCT invoice_no) FROM osum)", "0"),
    gate("duplicate_customer_ids", "(SELECT COUNT(*) - COUNT(DISTINCT customer_id) FROM rfm)", "0"),
    gate("customer_labels_complete", "(SELECT COUNT(*) FROM rfm WHERE segment IS NULL)", "0"), gate("partial_period_flags", FLAGGED_DAYS, FLAGGED_DAYS),
    gate("product_revenue_reconciles", TOTAL, TOTAL), gate("country_revenue_reconciles", TOTAL, TOTAL),
    gate("product_units_reconcile", UNITS, UNITS), gate("country_units_reconcile", UNITS, UNITS), gate("cohort_retention_bounds", BAD_CELLS, "0")]))

# Columns that Spark gives as 32-bit integers.
_INTEGERS = {
    "parquet_roundtrip": ["year"],
    "date_features": ["year", "quarter", "month", "day_of_month", "hour"],
    "customer_revenue_deciles": ["value_decile"],
    "customer_summary": ["active_span_days"],
    "weekday_performance": ["weekday_order"],
    "hourly_performance": ["hour"],
    "revenue_deciles_qcut": ["value_decile"],
    "dim_date": ["year", "quarter", "month", "day_of_month", "day_of_week_number"],
    "rfm_features": ["recency_days", "active_span_days"],
    "rfm_scores": ["r_score", "f_score", "m_score", "rfm_score"],
    "cohort_long": ["cohort_month_index"],
    "cohort_metadata": ["max_cohort_month_index"],
    "retention_curve": ["acquisition_year", "cohort_month_index"],
    "k_selection": ["rank_silhouette", "rank_calinski_harabasz", "rank_davies_bouldin", "rank_stability", "selection_rank_sum"],
    "dominant_segment": ["cluster_id"],
    "cluster_profiles": ["cluster_id"],
    "cluster_labels": ["cluster_id"],
    "cluster_mart": ["cluster_id"],
    "segment_cluster_crosstab": ["cluster_id"],
    "calendar": ["year", "quarter", "month_number"],
    "dim_customer_mart": ["recency_days", "r_score", "f_score", "m_score", "rfm_score", "cluster_id"],
    "measures_by_place": ["year"],
}
for name, columns in _INTEGERS.items():
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
    ORACLE[name] = f"SELECT * REPLACE ({casts}) FROM (\n{ORACLE[name]}\n)"

# Rows and column sums of every named statement, from the statements' own SQL.
_TEXT = {"check_name", "year_month", "country_name", "stock_code", "product_description", "customer_id",
         "primary_country", "first_purchase", "last_purchase"}


def _column_sums(name: str) -> str:
    columns = [c for c in MANIFEST[name][1].split(",") if c not in _TEXT]
    parts = [f"SELECT '{name}' AS query, 'rows' AS measure, CAST(COUNT(*) AS DOUBLE) AS value FROM (SELECT 1 FROM r_{name})"]
    parts += [f"SELECT '{name}', '{c}', round(SUM(CAST({c} AS DOUBLE)), 4) FROM r_{name}" for c in columns]
    return " UNION ALL ".join(parts)


ORACLE["named_query_batch"] = (
    "WITH " + ", ".join(f"r_{n} AS MATERIALIZED ({ORACLE[n]})" for n in MANIFEST)
    + " " + " UNION ALL ".join(_column_sums(n) for n in MANIFEST)
)
