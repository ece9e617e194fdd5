-- Business questions over the star tables. Facts are reduced to the grain of a
-- dimension key before that dimension is joined, so no fact row meets a join.

-- name: executive_kpis
WITH totals AS (
    SELECT sum(line_revenue) AS revenue,
           sum(line_revenue) FILTER (WHERE customer_key IS NOT NULL) AS known_revenue,
           count(DISTINCT invoice_no) AS orders,
           count(DISTINCT customer_key) AS customers
    FROM fact_sales
)
SELECT cast(round(revenue, 2) AS double) AS revenue_gbp,
       orders,
       customers AS identified_customers,
       cast(round(try_divide(revenue, orders), 2) AS double) AS average_order_value_gbp,
       cast(round(try_divide(coalesce(known_revenue, 0), customers), 2) AS double)
           AS revenue_per_identified_customer_gbp
FROM totals

-- name: monthly_revenue_growth
WITH orders_by_day AS (
    SELECT date_key, invoice_no, sum(line_revenue) AS revenue
    FROM fact_sales GROUP BY date_key, invoice_no
), by_month AS (
    SELECT d.year_month, round(sum(o.revenue), 2) AS revenue, count(DISTINCT o.invoice_no) AS orders
    FROM orders_by_day o JOIN dim_date d USING (date_key)
    GROUP BY d.year_month
), with_previous AS (
    SELECT *, lag(revenue) OVER (ORDER BY year_month) AS previous FROM by_month
)
SELECT year_month, cast(revenue AS double) AS revenue_gbp, orders,
       cast(round(try_divide(100 * (revenue - previous), previous), 2) AS double)
           AS month_over_month_growth_pct
FROM with_previous
ORDER BY year_month

-- name: country_performance
WITH by_key AS (
    SELECT country_key, sum(line_revenue) AS revenue, count(DISTINCT invoice_no) AS orders,
           count(DISTINCT customer_key) AS customers
    FROM fact_sales GROUP BY country_key
)
SELECT c.country_name, cast(round(revenue, 2) AS double) AS revenue_gbp, orders,
       customers AS identified_customers,
       cast(round(try_divide(revenue, orders), 2) AS double) AS average_order_value_gbp
FROM by_key JOIN dim_country c USING (country_key)
ORDER BY revenue_gbp DESC, country_name

-- name: top_products
WITH by_key AS (
    SELECT product_key, sum(quantity) AS units_sold, sum(line_revenue) AS revenue,
           count(DISTINCT invoice_no) AS order_count
    FROM fact_sales GROUP BY product_key
)
SELECT p.stock_code, p.product_description, units_sold,
       cast(round(revenue, 2) AS double) AS revenue_gbp, order_count
FROM by_key JOIN dim_product p USING (product_key)
ORDER BY round(revenue, 2) DESC, stock_code
LIMIT 20

-- name: top_customers
WITH by_key AS (
    SELECT customer_key, count(DISTINCT invoice_no) AS orders, sum(line_revenue) AS revenue,
           min(date_key) AS first_key, max(date_key) AS last_key
    FROM fact_sales WHERE customer_key IS NOT NULL GROUP BY customer_key
)
SELECT c.customer_id, c.primary_country, orders,
       cast(round(revenue, 2) AS double) AS customer_revenue_gbp,
       cast(round(try_divide(revenue, orders), 2) AS double) AS average_order_value_gbp,
       f.full_date AS first_purchase, l.full_date AS last_purchase
FROM by_key JOIN dim_customer c USING (customer_key)
JOIN dim_date f ON f.date_key = first_key
JOIN dim_date l ON l.date_key = last_key
ORDER BY round(revenue, 2) DESC, customer_id
LIMIT 20

-- name: repeat_customer_rate
WITH per_customer AS (
    SELECT customer_key, count(DISTINCT invoice_no) > 1 AS came_back
    FROM fact_sales WHERE customer_key IS NOT NULL GROUP BY customer_key
)
SELECT count(*) AS identified_customers, count_if(came_back) AS repeat_customers,
       cast(round(try_divide(100 * count_if(came_back), cast(count(*) AS decimal(20, 0))), 2) AS double)
           AS repeat_customer_rate_pct
FROM per_customer

-- name: product_returns
WITH by_key AS (
    SELECT product_key, count(DISTINCT invoice_no) AS return_invoices,
           sum(abs(quantity)) AS returned_units, abs(sum(signed_return_value)) AS lost
    FROM fact_returns GROUP BY product_key
)
SELECT p.stock_code, p.product_description, return_invoices, returned_units,
       cast(round(lost, 2) AS double) AS absolute_return_value_gbp
FROM by_key JOIN dim_product p USING (product_key)
ORDER BY round(lost, 2) DESC, stock_code
LIMIT 20

-- name: customer_revenue_deciles
-- ranked_customers: one row per customer with NTILE(10) by falling revenue,
-- computed without a global window.
SELECT value_decile, count(*) AS customers,
       cast(round(sum(revenue), 2) AS double) AS revenue_gbp,
       cast(round(try_divide(100 * sum(revenue), sum(sum(revenue)) OVER ()), 2) AS double)
           AS revenue_share_pct
FROM ranked_customers
GROUP BY value_decile
ORDER BY value_decile

-- name: outlier_profile
SELECT sum(is_quantity_outlier) AS quantity_outlier_lines,
       sum(is_unit_price_outlier) AS price_outlier_lines,
       sum(is_line_revenue_outlier) AS revenue_outlier_lines,
       cast(round(coalesce(sum(line_revenue) FILTER (WHERE is_line_revenue_outlier = 1), 0), 2) AS double)
           AS flagged_revenue_gbp
FROM fact_sales
