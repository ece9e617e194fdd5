-- Checks over the star tables. Fact rows are counted per key before the
-- anti-join, so its size follows the dimension and not the fact.

-- name: foreign_key_resolution
SELECT 'orphan_sales_dates' AS check_name, coalesce(sum(n), 0) AS failure_count
FROM (SELECT date_key, count(*) AS n FROM fact_sales GROUP BY date_key) LEFT ANTI JOIN dim_date USING (date_key)
UNION ALL
SELECT 'orphan_sales_products', coalesce(sum(n), 0)
FROM (SELECT product_key, count(*) AS n FROM fact_sales GROUP BY product_key) LEFT ANTI JOIN dim_product USING (product_key)
UNION ALL
SELECT 'orphan_sales_countries', coalesce(sum(n), 0)
FROM (SELECT country_key, count(*) AS n FROM fact_sales GROUP BY country_key) LEFT ANTI JOIN dim_country USING (country_key)
UNION ALL
SELECT 'orphan_return_dates', coalesce(sum(n), 0)
FROM (SELECT date_key, count(*) AS n FROM fact_returns GROUP BY date_key) LEFT ANTI JOIN dim_date USING (date_key)
UNION ALL
SELECT 'orphan_return_products', coalesce(sum(n), 0)
FROM (SELECT product_key, count(*) AS n FROM fact_returns GROUP BY product_key) LEFT ANTI JOIN dim_product USING (product_key)

-- name: partition_reconciliation
WITH sizes AS (
    SELECT (SELECT count(*) FROM fact_sales) AS completed_sales,
           (SELECT count(*) FROM fact_returns) AS returns_or_cancellations,
           (SELECT count(*) FROM audit_exclusions) AS excluded_non_sales
)
SELECT *, completed_sales + returns_or_cancellations + excluded_non_sales AS reconciled_unique_rows
FROM sizes

-- name: sales_value_reconciliation
SELECT cast(round(sum(line_revenue), 2) AS double) AS completed_sales_value_gbp,
       count(DISTINCT invoice_no) AS completed_orders,
       count(DISTINCT customer_key) AS identified_customers,
       count_if(customer_key IS NULL) AS anonymous_sales_lines
FROM fact_sales

-- name: returns_value_reconciliation
SELECT cast(round(sum(signed_return_value), 2) AS double) AS signed_returns_value_gbp,
       count(DISTINCT invoice_no) AS return_or_cancellation_invoices
FROM fact_returns
