"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written from the same definitions as the Spark side — the mapping in
``sources.testdata``, the clean projections, one-batch dimensions (keys =
ROW_NUMBER over the business key), facts, views and KPIs — but as plain SQL
over the driver tables.  Building blocks are CTEs; ``sql(body, *ctes)``
pulls in dependencies in order.

Numeric hygiene shared with the Spark side: money sums go through
decimal(18,2); means of integers are exact sum ÷ count; integer sums are
cast to bigint; calendar parts are cast to int; every ROW_NUMBER orders with
NULLS FIRST like Spark's ascending sort.
"""

from __future__ import annotations

# The keys that the schema design declares, typed here on their
# own, so that a key the audits forgot shows up.
PRIMARY_KEYS = {
    "dim_date": "date_sk", "dim_time": "time_sk", "dim_restaurant": "restaurant_sk", "dim_product": "product_sk",
    "dim_promotion": "promotion_sk", "dim_customer": "customer_sk", "dim_delivery_person": "delivery_person_sk",
    "fact_order": "order_sk", "fact_order_item": "order_item_sk", "fact_delivery": "delivery_sk",
    "fact_rating": "rating_sk"}
FOREIGN_KEYS = [
    ("dim_product", "restaurant_sk", "dim_restaurant", "restaurant_sk"),
    ("dim_promotion", "restaurant_sk", "dim_restaurant", "restaurant_sk"),
    ("fact_order", "customer_sk", "dim_customer", "customer_sk"),
    ("fact_order", "restaurant_sk", "dim_restaurant", "restaurant_sk"),
    ("fact_order", "order_date_sk", "dim_date", "date_sk"),
    ("fact_order", "order_time_sk", "dim_time", "time_sk"),
    ("fact_order", "promotion_sk", "dim_promotion", "promotion_sk"),
    ("fact_order_item", "order_sk", "fact_order", "order_sk"),
    ("fact_order_item", "product_sk", "dim_product", "product_sk"),
    ("fact_delivery", "order_sk", "fact_order", "order_sk"),
    ("fact_delivery", "delivery_person_sk", "dim_delivery_person", "delivery_person_sk"),
    ("fact_delivery", "pickup_date_sk", "dim_date", "date_sk"),
    ("fact_delivery", "pickup_time_sk", "dim_time", "time_sk"),
    ("fact_delivery", "delivery_date_sk", "dim_date", "date_sk"),
    ("fact_delivery", "delivery_time_sk", "dim_time", "time_sk"),
    ("fact_rating", "order_sk", "fact_order", "order_sk"),
    ("fact_rating", "customer_sk", "dim_customer", "customer_sk"),
    ("fact_rating", "restaurant_sk", "dim_restaurant", "restaurant_sk"),
    ("fact_rating", "delivery_person_sk", "dim_delivery_person", "delivery_person_sk"),
    ("fact_rating", "rating_date_sk", "dim_date", "date_sk"),
    ("fact_rating", "rating_time_sk", "dim_time", "time_sk"),
]
BATCH_TS = "TIMESTAMP '2025-01-01 00:00:00'"
SNAP_TS = ["TIMESTAMP '2025-01-01 00:00:00'", "TIMESTAMP '2025-02-01 00:00:00'"]

CTE: dict[str, tuple[list[str], str]] = {}
Q: dict[str, str] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTE[name] = (deps, body)


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS (\n{CTE[n][1]}\n)" for n in order)
    body = body.strip()
    if body[:4].upper() == "WITH":  # merge the body's own CTEs into one list
        return f"WITH {parts},\n{body[4:].lstrip()}"
    return f"WITH {parts}\n{body}"


def money_sum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def money_avg(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) / CAST(COUNT({x}) AS DOUBLE))"


def mean(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / CAST(COUNT({x}) AS DOUBLE))"


# ------------------------------------------------------------- clean layer --
cte("c_restaurants", [], f"""
SELECT CAST(s.s_suppkey AS VARCHAR) AS restaurant_id, s.s_name AS restaurant_name,
       'C' || CAST(s.s_suppkey % 5 AS VARCHAR) AS cuisine_type, CAST(NULL AS VARCHAR) AS address,
       n.n_name AS city, r.r_name AS state, 'USA' AS country,
       lpad(CAST(s.s_nationkey AS VARCHAR), 5, '0') AS postal_code,
       CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
       CAST(NULL AS VARCHAR) AS phone_number, CAST(NULL AS VARCHAR) AS email,
       CAST(NULL AS VARCHAR) AS operating_hours, s.s_acctbal AS rating,
       {BATCH_TS} AS effective_from, TRUE AS is_current, s.s_nationkey
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""")

cte("c_customers", [], """
SELECT CAST(c.c_custkey AS VARCHAR) AS customer_id, split_part(c.c_name, '#', 1) AS first_name,
       split_part(c.c_name, '#', 2) AS last_name, n.n_name AS city,
       CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS referral_customer_id,
       c.c_custkey, c.c_nationkey
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")

cte("c_products", [], """
SELECT CAST(p.p_partkey AS VARCHAR) AS product_id, CAST(m.supp AS VARCHAR) AS restaurant_id,
       p.p_name AS product_name, p.p_brand AS description, p.p_type AS category,
       p.p_retailprice AS price, CAST(p.p_size AS DOUBLE) + 0.5 AS cost,
       FALSE AS is_vegetarian, FALSE AS is_vegan, FALSE AS is_gluten_free,
       CAST(NULL AS INTEGER) AS calories, CAST(NULL AS INTEGER) AS preparation_time
FROM part p LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS supp FROM lineitem GROUP BY 1) m
  ON p.p_partkey = m.l_partkey""")

cte("c_promotions", [], """
SELECT substr(o_orderpriority, 1, 1) AS promotion_id, o_orderpriority AS promotion_name,
       'Orders of priority ' || o_orderpriority AS description,
       CASE (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) % 3
            WHEN 0 THEN 'percentage' WHEN 1 THEN 'fixed' WHEN 2 THEN 'bogo' END AS discount_type,
       CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 5 AS DOUBLE) AS discount_value,
       CAST(min(o_orderdate) AS DATE) AS start_date, CAST(max(o_orderdate) AS DATE) AS end_date,
       CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 10 AS DOUBLE) AS min_order_value,
       CAST(CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) < 4
                 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 20 END AS DOUBLE) AS max_discount,
       CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 2 = 1
            THEN substr(o_orderpriority, 1, 1) END AS restaurant_id,
       substr(o_orderpriority, 1, 1) <> '5' AS is_active
FROM orders GROUP BY o_orderpriority""")

cte("c_orders", [], """
SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id, CAST(o.o_custkey AS VARCHAR) AS customer_id,
       CAST(m.supp AS VARCHAR) AS restaurant_id, o.o_orderdate AS order_date,
       CASE o.o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'In Progress'
            WHEN 'P' THEN 'Preparing' END AS order_status,
       o.o_totalprice AS order_total, floor(o.o_totalprice * 5) / 100 AS tip_amount,
       substr(o.o_orderpriority, 1, 1) AS promotion_id,
       e.rating AS rating, e.drating AS delivery_rating, o.o_orderdate AS created_at, o.o_orderdate AS updated_at
FROM orders o
LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM lineitem GROUP BY 1) m
  ON o.o_orderkey = m.l_orderkey
LEFT JOIN (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1 AS rating,
                  CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 2 AS drating
           FROM events WHERE event_type <> 'error') e ON o.o_orderkey = e.event_id""")

cte("c_order_items", [], """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS order_item_id,
       CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
       CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice / l_quantity AS unit_price,
       (l_extendedprice / l_quantity) * CAST(l_quantity AS INTEGER) AS item_total
FROM lineitem""")

cte("ev", [], """
SELECT e.*, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS t0,
       CASE WHEN event_type = 'error' THEN NULL
            ELSE hour(p) * 3600 + minute(p) * 60 + second(p) END AS t1,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day_ts
FROM (SELECT *, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS p,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e""")

cte("c_delivery", ["ev"], """
SELECT CAST(event_id AS VARCHAR) AS delivery_id, CAST(event_id AS VARCHAR) AS order_id,
       CAST(user_id AS VARCHAR) AS delivery_person_id,
       day_ts + to_seconds(t0) AS pickup_time,
       CASE WHEN t1 IS NULL THEN NULL
            ELSE day_ts + to_seconds(CASE WHEN t1 < t0 THEN t1 + 86400 ELSE t1 END) END
         AS delivery_time,
       CASE event_type WHEN 'view' THEN 'Sunny' WHEN 'click' THEN 'Cloudy'
            WHEN 'signup' THEN 'Windy' WHEN 'purchase' THEN 'Stormy'
            WHEN 'error' THEN 'Foggy' END AS weather_conditions,
       CASE WHEN k < 25 THEN 'Low' WHEN k < 50 THEN 'Medium' WHEN k < 75 THEN 'High'
            ELSE 'Jam' END AS traffic_density,
       CASE user_id % 3 WHEN 0 THEN 'motorcycle' WHEN 1 THEN 'scooter'
            WHEN 2 THEN 'electric_scooter' END AS vehicle_type,
       day_ts AS created_at, (k % 40) * 0.25 + 0.5 AS delivery_distance,
       CASE WHEN t1 IS NULL THEN NULL ELSE greatest(300, least(7200, abs(t1 - t0))) END
         AS clip_secs
FROM ev""")

cte("c_ratings", ["c_orders"], """
SELECT order_id || '-rating' AS rating_id, order_id, customer_id,
       restaurant_id, delivery_rating, rating AS overall_rating, updated_at AS created_at
FROM c_orders WHERE rating IS NOT NULL""")

# ------------------------------------------------------------- dimensions --
cte("d_restaurant", ["c_restaurants"], """
SELECT row_number() OVER (ORDER BY restaurant_id) AS restaurant_sk, * FROM c_restaurants""")

cte("d_customer", ["c_customers"], """
SELECT row_number() OVER (ORDER BY customer_id) AS customer_sk, *, TRUE AS is_current
FROM c_customers""")

cte("d_promotion", ["c_promotions", "d_restaurant"], """
SELECT p.*, r.restaurant_sk, TRUE AS is_current FROM
  (SELECT row_number() OVER (ORDER BY promotion_id) AS promotion_sk, * FROM c_promotions) p
LEFT JOIN d_restaurant r ON p.restaurant_id = r.restaurant_id""")

cte("d_product", ["c_products", "d_restaurant"], """
SELECT p.*, r.restaurant_sk, TRUE AS is_current FROM
  (SELECT row_number() OVER (ORDER BY product_id) AS product_sk, * FROM c_products) p
LEFT JOIN d_restaurant r ON p.restaurant_id = r.restaurant_id""")

cte("d_delivery_person", ["c_delivery"], """
SELECT row_number() OVER (ORDER BY delivery_person_id) AS delivery_person_sk,
       delivery_person_id, vehicle_type, TRUE AS is_active, TRUE AS is_current
FROM (SELECT delivery_person_id,
             arg_max(vehicle_type, (coalesce(pickup_time, created_at), delivery_id))
               AS vehicle_type
      FROM c_delivery GROUP BY 1)""")

cte("cal_dates", ["c_orders", "c_ratings", "c_delivery"], """
SELECT CAST(order_date AS DATE) AS d FROM c_orders
UNION ALL SELECT CAST(pickup_time AS DATE) FROM c_delivery
UNION ALL SELECT CAST(delivery_time AS DATE) FROM c_delivery
UNION ALL SELECT CAST(created_at AS DATE) FROM c_ratings""")

cte("d_date", ["cal_dates"], """
SELECT CAST(datediff('day', b.lo, g.d) + 1 AS BIGINT) AS date_sk, CAST(g.d AS DATE) AS date_id,
       CAST(dayofweek(g.d) AS INTEGER) AS day_of_week, strftime(g.d, '%a') AS day_of_week_name,
       CAST(dayofmonth(g.d) AS INTEGER) AS day_of_month,
       CAST(dayofyear(g.d) AS INTEGER) AS day_of_year,
       CAST(weekofyear(g.d) AS INTEGER) AS week_of_year,
       CAST(month(g.d) AS INTEGER) AS month_number, strftime(g.d, '%b') AS month_name,
       CAST(quarter(g.d) AS INTEGER) AS quarter, CAST(year(g.d) AS INTEGER) AS year,
       dayofweek(g.d) IN (0, 6) AS is_weekend, FALSE AS is_holiday,
       CAST(NULL AS VARCHAR) AS holiday_name, CAST(year(g.d) AS INTEGER) AS fiscal_year,
       CAST(quarter(g.d) AS INTEGER) AS fiscal_quarter
FROM (SELECT CAST(date_trunc('year', min(d)) AS DATE) AS lo,
             CAST(date_trunc('year', max(d)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS hi
      FROM cal_dates) b,
     LATERAL (SELECT CAST(unnest(generate_series(b.lo, b.hi, INTERVAL 1 DAY)) AS DATE) AS d) g""")

cte("d_time", [], """
SELECT CAST(m + 1 AS BIGINT) AS time_sk, CAST(m AS INTEGER) AS minute_of_day,
       CAST(m // 60 AS INTEGER) AS hour_of_day, CAST(m % 60 AS INTEGER) AS minute_of_hour,
       CASE WHEN m // 60 < 12 THEN 'AM' ELSE 'PM' END AS am_pm,
       CASE WHEN m // 60 BETWEEN 5 AND 11 THEN 'Morning'
            WHEN m // 60 BETWEEN 12 AND 16 THEN 'Afternoon'
            WHEN m // 60 BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END
         AS time_of_day_category
FROM range(1440) t(m)""")

# ------------------------------------------------------------------ facts --
cte("f_order", ["c_orders", "d_customer", "d_restaurant", "d_promotion", "d_date"], """
SELECT row_number() OVER (ORDER BY o.order_id) AS order_sk, o.order_id,
       c.customer_sk, r.restaurant_sk, d.date_sk AS order_date_sk,
       CAST(hour(o.order_date) * 60 + minute(o.order_date) + 1 AS BIGINT) AS order_time_sk,
       p.promotion_sk, o.order_status, o.order_total, o.tip_amount, o.order_date
FROM c_orders o
LEFT JOIN d_customer c ON o.customer_id = c.customer_id
LEFT JOIN d_restaurant r ON o.restaurant_id = r.restaurant_id
LEFT JOIN d_promotion p ON o.promotion_id = p.promotion_id
LEFT JOIN d_date d ON CAST(o.order_date AS DATE) = d.date_id""")

cte("f_order_item", ["c_order_items", "f_order", "d_product"], """
SELECT i.order_item_sk, i.order_item_id, o.order_sk, p.product_sk, i.quantity, i.unit_price,
       i.item_total
FROM (SELECT row_number() OVER (ORDER BY order_item_id, order_id, product_id, quantity,
                                unit_price) AS order_item_sk, * FROM c_order_items) i
JOIN f_order o ON i.order_id = o.order_id
LEFT JOIN d_product p ON i.product_id = p.product_id""")

cte("f_delivery", ["c_delivery", "f_order", "d_delivery_person", "d_date"], """
SELECT row_number() OVER (ORDER BY x.delivery_id) AS delivery_sk, x.* FROM (
SELECT d.delivery_id, o.order_sk, dp.delivery_person_sk,
       pd.date_sk AS pickup_date_sk,
       CAST(hour(d.pickup_time) * 60 + minute(d.pickup_time) + 1 AS BIGINT) AS pickup_time_sk,
       dd.date_sk AS delivery_date_sk,
       CAST(hour(d.delivery_time) * 60 + minute(d.delivery_time) + 1 AS BIGINT)
         AS delivery_time_sk,
       date_diff('minute', d.pickup_time, d.delivery_time) AS delivery_duration_minutes,
       CAST(d.delivery_distance AS DOUBLE) AS delivery_distance,
       d.weather_conditions, d.traffic_density
FROM c_delivery d
LEFT JOIN f_order o ON d.order_id = o.order_id
LEFT JOIN d_delivery_person dp ON d.delivery_person_id = dp.delivery_person_id
LEFT JOIN d_date pd ON CAST(d.pickup_time AS DATE) = pd.date_id
LEFT JOIN d_date dd ON CAST(d.delivery_time AS DATE) = dd.date_id) x""")

cte("f_rating", ["c_ratings", "f_order", "f_delivery", "d_customer", "d_restaurant", "d_date"], """
SELECT row_number() OVER (ORDER BY r.rating_id) AS rating_sk, r.rating_id, o.order_sk,
       c.customer_sk, s.restaurant_sk, p.delivery_person_sk, d.date_sk AS rating_date_sk,
       CAST(hour(r.created_at) * 60 + minute(r.created_at) + 1 AS BIGINT) AS rating_time_sk,
       r.overall_rating, r.delivery_rating
FROM c_ratings r
LEFT JOIN f_order o ON r.order_id = o.order_id
LEFT JOIN d_customer c ON r.customer_id = c.customer_id
LEFT JOIN d_restaurant s ON r.restaurant_id = s.restaurant_id
LEFT JOIN (SELECT order_sk, arg_max(delivery_person_sk, delivery_sk) AS delivery_person_sk
           FROM f_delivery WHERE order_sk IS NOT NULL GROUP BY 1) p ON o.order_sk = p.order_sk
LEFT JOIN d_date d ON CAST(r.created_at AS DATE) = d.date_id""")

# ----------------------------------------------------------------- queries --
Q["dim_date"] = sql("SELECT * FROM d_date", "d_date")

Q["deliveries_by_time_of_day"] = sql("""
SELECT t.hour_of_day, t.am_pm, t.time_of_day_category, COUNT(*) AS deliveries
FROM f_delivery f JOIN d_time t ON f.pickup_time_sk = t.time_sk
GROUP BY 1, 2, 3""", "f_delivery", "d_time")

_CLEAN_SELECT = {
    "restaurants": "restaurant_id, restaurant_name, cuisine_type, address, city, state, country, "
                   "postal_code, latitude, longitude, phone_number, email, operating_hours, "
                   "rating, effective_from, is_current",
    "products": "product_id, restaurant_id, product_name, description, category, price, cost, "
                "is_vegetarian, is_vegan, is_gluten_free, calories, preparation_time",
    "promotions": "promotion_id, promotion_name, description, discount_type, discount_value, "
                  "start_date, end_date, min_order_value, max_discount, restaurant_id, "
                  "is_active",
    "customers": "customer_id, first_name, last_name, city, state, referral_customer_id",
    "orders": "order_id, customer_id, restaurant_id, order_date, order_status, order_total, "
              "tip_amount, promotion_id",
    "order_items": "order_item_id, order_id, product_id, quantity, unit_price, item_total",
    "delivery": "delivery_id, order_id, delivery_person_id, pickup_time, delivery_time, "
                "weather_conditions, traffic_density, vehicle_type, created_at",
    "ratings": "rating_id, order_id, customer_id, overall_rating, created_at",
}
for _n, _cols in _CLEAN_SELECT.items():
    Q[f"clean_{_n}"] = sql(f"SELECT {_cols} FROM c_{_n}", f"c_{_n}")

Q["dim_delivery_person"] = sql("SELECT * FROM d_delivery_person", "d_delivery_person")

# --- SCD2: two customer extracts ---------------------------------------------
cte("snap0", ["c_customers"], "SELECT * FROM c_customers WHERE c_nationkey < 20")
cte("snap1", ["c_customers"], """
SELECT customer_id, first_name, last_name,
       CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN city || ' North'
            ELSE city END AS city
FROM c_customers""")
cte("scd_v0", ["snap0"], f"""
SELECT row_number() OVER (ORDER BY customer_id) AS customer_sk, customer_id, first_name,
       last_name, city, {SNAP_TS[0]} AS effective_from
FROM snap0""")
cte("scd_opens", ["scd_v0", "snap1"], """
SELECT s.*, v.customer_sk AS old_sk
FROM snap1 s LEFT JOIN scd_v0 v ON s.customer_id = v.customer_id
WHERE v.customer_id IS NULL OR s.first_name IS DISTINCT FROM v.first_name
   OR s.last_name IS DISTINCT FROM v.last_name OR s.city IS DISTINCT FROM v.city""")
cte("scd_result", ["scd_v0", "scd_opens"], f"""
SELECT v.customer_sk, v.customer_id, v.first_name, v.last_name, v.city, v.effective_from,
       CASE WHEN o.customer_id IS NULL THEN CAST(NULL AS TIMESTAMP) ELSE {SNAP_TS[1]} END
         AS effective_to,
       o.customer_id IS NULL AS is_current
FROM scd_v0 v LEFT JOIN scd_opens o ON v.customer_id = o.customer_id
UNION ALL
SELECT (SELECT COUNT(*) FROM scd_v0) + row_number() OVER (ORDER BY customer_id),
       customer_id, first_name, last_name, city, {SNAP_TS[1]},
       CAST(NULL AS TIMESTAMP), TRUE
FROM scd_opens""")
Q["scd2_merge"] = sql("SELECT * FROM scd_result", "scd_result")
Q["incremental_scd2"] = Q["scd2_merge"]

Q["scd2_from_log"] = sql("""
WITH log AS (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_orderpriority AS priority,
                    o_orderdate AS ts, o_orderkey AS k FROM orders),
ch AS (SELECT *, lag(priority) OVER (PARTITION BY customer_id ORDER BY ts, k) AS prev,
              row_number() OVER (PARTITION BY customer_id ORDER BY ts, k) AS rn FROM log),
v AS (SELECT * FROM ch WHERE rn = 1 OR priority IS DISTINCT FROM prev),
w AS (SELECT *, lead(ts) OVER (PARTITION BY customer_id ORDER BY ts, k) AS nxt FROM v)
SELECT row_number() OVER (ORDER BY customer_id, ts, k) AS version_sk, customer_id, priority,
       ts AS effective_from, nxt AS effective_to, nxt IS NULL AS is_current
FROM w""")

Q["latest_per_key"] = """
SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
       arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority,
       max(o_orderdate) AS changed_at,
       arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS order_key
FROM orders GROUP BY 1"""

Q["fact_order_as_of"] = sql(f"""
WITH ver AS (
  SELECT customer_sk, customer_id,
         CASE WHEN effective_from = {SNAP_TS[0]} THEN TIMESTAMP '1994-01-01' ELSE TIMESTAMP '1996-07-01' END AS lo,
         CASE WHEN effective_to IS NOT NULL THEN TIMESTAMP '1996-07-01' END AS hi
  FROM scd_result)
SELECT o.order_sk, o.order_id, v.customer_sk,
       CASE WHEN o.order_date >= TIMESTAMP '1994-01-01' THEN o.restaurant_sk END AS restaurant_sk,
       CASE WHEN o.order_date >= TIMESTAMP '1994-01-01' THEN o.promotion_sk END AS promotion_sk,
       o.order_date_sk, o.order_total
FROM f_order o JOIN c_orders c ON o.order_id = c.order_id
LEFT JOIN ver v ON v.customer_id = c.customer_id AND o.order_date >= v.lo AND (v.hi IS NULL OR o.order_date < v.hi)
""", "f_order", "scd_result", "c_orders")

# --- facts ---------------------------------------------------------------------
Q["fact_order"] = sql("""
SELECT order_sk, order_id, customer_sk, restaurant_sk, order_date_sk, order_time_sk,
       promotion_sk, order_status, order_total, tip_amount FROM f_order""", "f_order")
Q["fact_order_item"] = sql("SELECT * FROM f_order_item", "f_order_item")
Q["fact_delivery"] = sql("""
SELECT delivery_sk, delivery_id, order_sk, delivery_person_sk, pickup_date_sk, pickup_time_sk,
       delivery_date_sk, delivery_time_sk, delivery_duration_minutes, weather_conditions,
       traffic_density FROM f_delivery""", "f_delivery")
Q["fact_rating"] = sql("""
SELECT rating_sk, rating_id, order_sk, customer_sk, restaurant_sk, delivery_person_sk,
       rating_date_sk, rating_time_sk, overall_rating FROM f_rating""", "f_rating")

# --- views ---------------------------------------------------------------------
Q["vw_restaurant_order_performance"] = sql(f"""
SELECT r.restaurant_name, r.cuisine_type, r.city, r.state, d.year, d.month_name,
       COUNT(DISTINCT o.order_id) AS total_orders,
       {money_sum('o.order_total')} AS total_revenue,
       {money_avg('o.order_total')} AS avg_order_value,
       {money_sum('o.tip_amount')} AS total_tips,
       {money_avg('o.tip_amount')} AS avg_tip_amount
FROM f_order o
JOIN d_restaurant r ON o.restaurant_sk = r.restaurant_sk
JOIN d_date d ON o.order_date_sk = d.date_sk
WHERE r.is_current
GROUP BY 1, 2, 3, 4, 5, 6""", "f_order", "d_restaurant", "d_date")

Q["vw_delivery_performance"] = sql(f"""
SELECT dp.delivery_person_id, d.year, d.month_name,
       COUNT(fd.delivery_id) AS total_deliveries,
       {mean('fd.delivery_duration_minutes')} AS avg_delivery_time,
       {mean('fd.delivery_distance')} AS avg_delivery_distance,
       CAST(SUM(fr.rsum) AS DOUBLE) / CAST(SUM(fr.rcnt) AS DOUBLE) AS avg_delivery_rating
FROM f_delivery fd
JOIN d_delivery_person dp ON fd.delivery_person_sk = dp.delivery_person_sk
JOIN d_date d ON fd.delivery_date_sk = d.date_sk
LEFT JOIN (SELECT order_sk, SUM(delivery_rating) AS rsum, COUNT(delivery_rating) AS rcnt
           FROM f_rating WHERE order_sk IS NOT NULL GROUP BY 1) fr ON fd.order_sk = fr.order_sk
WHERE dp.is_current
GROUP BY 1, 2, 3""", "f_delivery", "d_delivery_person", "d_date", "f_rating")

Q["vw_delivery_performance_literal"] = sql(f"""
SELECT dp.delivery_person_id, d.year, d.month_name,
       COUNT(fd.delivery_id) AS total_deliveries,
       {mean('fd.delivery_duration_minutes')} AS avg_delivery_time,
       {mean('fd.delivery_distance')} AS avg_delivery_distance,
       {mean('fr.delivery_rating')} AS avg_delivery_rating
FROM f_delivery fd
JOIN d_delivery_person dp ON fd.delivery_person_sk = dp.delivery_person_sk
JOIN d_date d ON fd.delivery_date_sk = d.date_sk
LEFT JOIN f_rating fr ON fd.order_sk = fr.order_sk
WHERE dp.is_current
GROUP BY 1, 2, 3""", "f_delivery", "d_delivery_person", "d_date", "f_rating")

Q["vw_customer_order_patterns"] = sql(f"""
SELECT c.customer_id, c.city, c.state, d.year, d.month_name,
       COUNT(DISTINCT o.order_id) AS total_orders,
       {money_sum('o.order_total')} AS total_spent,
       {money_avg('o.order_total')} AS avg_order_value,
       COUNT(DISTINCT r.restaurant_id) AS unique_restaurants_ordered
FROM f_order o
JOIN d_customer c ON o.customer_sk = c.customer_sk
JOIN d_date d ON o.order_date_sk = d.date_sk
JOIN d_restaurant r ON o.restaurant_sk = r.restaurant_sk
WHERE c.is_current AND r.is_current
GROUP BY 1, 2, 3, 4, 5""", "f_order", "d_customer", "d_date", "d_restaurant")

Q["vw_product_performance"] = sql(f"""
SELECT p.product_name, p.category, r.restaurant_name, d.year, d.month_name,
       CAST(SUM(oi.quantity) AS BIGINT) AS total_quantity_sold,
       {money_sum('oi.item_total')} AS total_revenue,
       COUNT(DISTINCT o.order_id) AS order_count
FROM f_order_item oi
JOIN d_product p ON oi.product_sk = p.product_sk
JOIN f_order o ON oi.order_sk = o.order_sk
JOIN d_restaurant r ON p.restaurant_sk = r.restaurant_sk
JOIN d_date d ON o.order_date_sk = d.date_sk
WHERE p.is_current AND r.is_current
GROUP BY 1, 2, 3, 4, 5""", "f_order_item", "d_product", "f_order", "d_restaurant", "d_date")

Q["vw_promotion_effectiveness"] = sql(f"""
SELECT p.promotion_name, p.discount_type, p.discount_value, d.year, d.month_name,
       COUNT(DISTINCT o.order_id) AS total_orders,
       {money_sum('o.order_total')} AS total_revenue,
       {money_avg('o.order_total')} AS avg_order_value,
       {money_sum('o.order_total')} / CAST(COUNT(DISTINCT o.order_id) AS DOUBLE)
         AS revenue_per_order
FROM f_order o
JOIN d_promotion p ON o.promotion_sk = p.promotion_sk
JOIN d_date d ON o.order_date_sk = d.date_sk
WHERE p.is_current
GROUP BY 1, 2, 3, 4, 5""", "f_order", "d_promotion", "d_date")

# --- dashboard KPIs ------------------------------------------------------------
Q["daily_orders"] = sql("""
SELECT CAST(order_date AS DATE) AS date, COUNT(*) AS order_count
FROM c_orders WHERE order_date IS NOT NULL GROUP BY 1""", "c_orders")

Q["daily_orders_filtered"] = sql("""
SELECT CAST(order_date AS DATE) AS date, COUNT(*) AS order_count
FROM c_orders
WHERE CAST(order_date AS DATE) BETWEEN
      (SELECT max(CAST(order_date AS DATE)) - 29 FROM c_orders)
  AND (SELECT max(CAST(order_date AS DATE)) FROM c_orders)
GROUP BY 1""", "c_orders")

Q["delivery_minutes"] = sql("""
SELECT delivery_id, weather_conditions, traffic_density,
       CAST(clip_secs AS BIGINT) AS delivery_seconds, CAST(clip_secs AS DOUBLE) / CAST(60 AS DOUBLE) AS delivery_time_minutes
FROM c_delivery""", "c_delivery")

Q["status_distribution"] = sql("""
SELECT order_status AS status, COUNT(*) AS count FROM c_orders
WHERE order_status IS NOT NULL GROUP BY 1""", "c_orders")

Q["weather_impact"] = sql(f"""
SELECT weather_conditions, {mean('clip_secs')} / CAST(60 AS DOUBLE) AS avg_delivery_minutes
FROM c_delivery WHERE weather_conditions IS NOT NULL GROUP BY 1""", "c_delivery")

Q["traffic_impact"] = sql(f"""
SELECT traffic_density, {mean('clip_secs')} / CAST(60 AS DOUBLE) AS avg_delivery_minutes
FROM c_delivery WHERE traffic_density IS NOT NULL GROUP BY 1""", "c_delivery")

Q["top_restaurants"] = sql("""
SELECT restaurant_id, restaurant_name, cuisine_type, rating FROM c_restaurants
WHERE rating IS NOT NULL ORDER BY rating DESC, restaurant_id LIMIT 10""", "c_restaurants")

Q["kpi_row"] = sql(f"""
SELECT (SELECT COUNT(*) FROM c_orders) AS total_orders,
       (SELECT {mean('clip_secs')} / CAST(60 AS DOUBLE) FROM c_delivery) AS avg_delivery_minutes,
       (SELECT {mean('rating')} FROM c_orders) AS avg_rating,
       (SELECT {money_avg('tip_amount')} FROM c_orders) AS avg_tip""", "c_orders", "c_delivery")

Q["monthly_orders"] = sql("""
SELECT CAST(date_trunc('month', CAST(order_date AS DATE)) AS DATE) AS month, COUNT(*) AS order_count
FROM c_orders WHERE order_date IS NOT NULL GROUP BY 1""", "c_orders")

Q["mom_growth"] = sql("""
WITH m AS (SELECT CAST(date_trunc('month', CAST(order_date AS DATE)) AS DATE) AS month,
                  COUNT(*) AS order_count
           FROM c_orders WHERE order_date IS NOT NULL GROUP BY 1),
g AS (SELECT *, lag(order_count) OVER (ORDER BY month) AS previous_count FROM m)
SELECT month, order_count, previous_count,
       CAST(order_count - previous_count AS DOUBLE) / CAST(previous_count AS DOUBLE) * CAST(100 AS DOUBLE)
         AS mom_growth_pct
FROM g ORDER BY month DESC LIMIT 1""", "c_orders")

Q["top_promotions"] = sql(f"""
SELECT p.promotion_name, p.discount_type, p.discount_value,
       COUNT(DISTINCT o.order_id) AS orders, {money_sum('o.order_total')} AS revenue,
       {money_avg('o.order_total')} AS avg_order_value
FROM f_order o JOIN d_promotion p ON o.promotion_sk = p.promotion_sk
WHERE p.is_current AND p.is_active
GROUP BY 1, 2, 3 ORDER BY orders DESC, promotion_name LIMIT 10""", "f_order", "d_promotion")

Q["filter_choices"] = sql("""
WITH v AS (SELECT DISTINCT * FROM (
    SELECT 'city' AS filter, city AS value FROM c_restaurants
    UNION ALL SELECT 'cuisine', cuisine_type FROM c_restaurants
    UNION ALL SELECT 'weather', weather_conditions FROM c_delivery) WHERE value IS NOT NULL)
SELECT filter, 'All' AS value FROM (SELECT DISTINCT filter FROM v)
UNION ALL SELECT filter, value FROM v""", "c_restaurants", "c_delivery")

Q["date_bounds"] = sql("""
SELECT min(CAST(order_date AS DATE)) AS min_date, max(CAST(order_date AS DATE)) AS max_date
FROM c_orders""", "c_orders")

# --- audits --------------------------------------------------------------------
_STAR = {"dim_date": "d_date", "dim_time": "d_time", "dim_restaurant": "d_restaurant",
         "dim_product": "d_product", "dim_promotion": "d_promotion",
         "dim_customer": "d_customer", "dim_delivery_person": "d_delivery_person",
         "fact_order": "f_order", "fact_order_item": "f_order_item",
         "fact_delivery": "f_delivery", "fact_rating": "f_rating"}
_BUSINESS = {"clean_restaurants": ("c_restaurants", "restaurant_id"),
             "clean_products": ("c_products", "product_id"),
             "clean_customers": ("c_customers", "customer_id"),
             "clean_orders": ("c_orders", "order_id"),
             "clean_order_items": ("c_order_items", "order_item_id"),
             "clean_delivery": ("c_delivery", "delivery_id"),
             "clean_ratings": ("c_ratings", "rating_id")}

_pk_parts = [(t, _STAR[t], k) for t, k in PRIMARY_KEYS.items()]
_pk_parts += [(t, c, k) for t, (c, k) in _BUSINESS.items()]
Q["audit_pk"] = sql("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST({k} AS VARCHAR) AS key_value, COUNT(*) AS occurrences "
    f"FROM {c} WHERE {k} IS NOT NULL GROUP BY {k} HAVING COUNT(*) > 1"
    for t, c, k in _pk_parts), *sorted({c for _, c, _ in _pk_parts}))

Q["audit_fk"] = sql("\nUNION ALL\n".join(
    f"SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, "
    f"COUNT(*) AS child_rows, COUNT(*) FILTER (WHERE x.{cc} IS NULL) AS null_rows, "
    f"COUNT(*) FILTER (WHERE x.{cc} IS NOT NULL AND x.{cc} NOT IN "
    f"(SELECT {pc} FROM {_STAR[pt]} WHERE {pc} IS NOT NULL)) AS orphan_rows "
    f"FROM {_STAR[ct]} x"
    for ct, cc, pt, pc in FOREIGN_KEYS), *sorted(set(_STAR.values())))

_PK = {"fact_order": "order_sk", "fact_order_item": "order_item_sk", "fact_delivery": "delivery_sk",
       "fact_rating": "rating_sk"}
Q["audit_incremental"] = sql("\nUNION ALL\n".join(
    f"SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, "
    f"COUNT(*) AS child_rows, COUNT(*) FILTER (WHERE x.{cc} IS NULL) AS null_rows, "
    f"COUNT(*) FILTER (WHERE x.{cc} IS NOT NULL AND x.{cc} NOT IN "
    f"(SELECT {pc} FROM {_STAR[pt]} WHERE {pc} IS NOT NULL)) AS orphan_rows, "
    f"COUNT(x.{_PK[ct]}) - COUNT(DISTINCT x.{_PK[ct]}) AS duplicate_keys FROM {_STAR[ct]} x"
    for ct, cc, pt, pc in FOREIGN_KEYS if ct in _PK), *sorted(set(_STAR.values())))

_recon = [("restaurants", "stage", "c_restaurants"), ("restaurants", "clean", "c_restaurants"),
          ("restaurants", "dimension", "d_restaurant"), ("customers", "stage", "c_customers"),
          ("customers", "clean", "c_customers"), ("customers", "dimension", "d_customer"),
          ("products", "stage", "c_products"), ("products", "clean", "c_products"),
          ("products", "dimension", "d_product"), ("promotions", "stage", "c_promotions"),
          ("promotions", "clean", "c_promotions"), ("promotions", "dimension", "d_promotion"),
          ("orders", "stage", "c_orders"), ("orders", "clean", "c_orders"),
          ("orders", "fact", "f_order"), ("order_items", "stage", "c_order_items"),
          ("order_items", "clean", "c_order_items"), ("order_items", "fact", "f_order_item"),
          ("delivery", "stage", "c_delivery"), ("delivery", "clean", "c_delivery"),
          ("delivery", "fact", "f_delivery"), ("ratings", "clean", "c_ratings"),
          ("ratings", "fact", "f_rating")]
Q["audit_reconcile"] = sql("\nUNION ALL\n".join(
    f"SELECT '{e}' AS entity, '{layer}' AS layer, COUNT(*) AS row_count FROM {c}"
    for e, layer, c in _recon), *sorted({c for _, _, c in _recon}))

Q["audit_lookup_completeness"] = sql("\nUNION ALL\n".join(
    f"SELECT 'fact_order' AS table_name, '{k}' AS key_column, COUNT(*) AS fact_rows, "
    f"COUNT(*) - COUNT({k}) AS missing FROM f_order"
    for k in ["customer_sk", "restaurant_sk", "order_date_sk", "order_time_sk",
              "promotion_sk"]), "f_order")

# --- incremental, files ----------------------------------------------------------
Q["high_water_mark"] = sql("""
SELECT order_id, order_date FROM c_orders
WHERE order_date > (SELECT coalesce(max(order_date), TIMESTAMP '1900-01-01')
                    FROM c_orders WHERE order_date < TIMESTAMP '1998-01-01')""", "c_orders")

Q["csv_roundtrip"] = Q["clean_promotions"]

Q["csv_quarantine"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
       (o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'))
         AS quarantined
FROM orders"""

Q["multi_source_union"] = sql("""
SELECT restaurant_id, restaurant_name, cuisine_type, city, state, postal_code, rating,
       CASE WHEN s_nationkey < 12 THEN 'restaurants_csv' ELSE 'feed2_csv' END AS source_system
FROM c_restaurants""", "c_restaurants")

Q["incremental_clean"] = Q["clean_orders"]

Q["incremental_fact_order"] = sql("""
WITH b AS (SELECT *, CASE WHEN order_date < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS batch
           FROM f_order)
SELECT CASE WHEN batch = 0 THEN 0 ELSE (SELECT COUNT(*) FROM b WHERE batch = 0) END
         + row_number() OVER (PARTITION BY batch ORDER BY order_id) AS order_sk,
       order_id, customer_sk, restaurant_sk, order_date_sk, order_time_sk, promotion_sk,
       order_status, order_total, tip_amount
FROM b""", "f_order")


Q["load_late_parents"] = sql("""
SELECT 'item' AS fact, f.order_item_id AS id, o.order_id, f.item_total AS amount,
       CAST(NULL AS BIGINT) AS delivery_person_sk
FROM f_order_item f JOIN f_order o ON f.order_sk = o.order_sk
UNION ALL
SELECT 'delivery', f.delivery_id, o.order_id, CAST(f.delivery_duration_minutes AS DOUBLE), f.delivery_person_sk
FROM f_delivery f LEFT JOIN f_order o ON f.order_sk = o.order_sk
UNION ALL
SELECT 'rating', f.rating_id, o.order_id, CAST(f.overall_rating AS DOUBLE), f.delivery_person_sk
FROM f_rating f LEFT JOIN f_order o ON f.order_sk = o.order_sk""",
                             "f_order_item", "f_delivery", "f_rating", "f_order")

Q["csv_null_markers"] = sql("""
WITH i AS (SELECT *, CAST(replace(order_item_id, '-', '') AS BIGINT) AS n FROM c_order_items),
bad AS (SELECT order_item_id, 'item_quantity' AS c, 'two' AS v, 'not a int' AS why FROM i WHERE n % 25 = 1 AND n % 4 <> 0
        UNION ALL SELECT order_item_id, 'price', '1,5', 'not a double' FROM i WHERE n % 50 = 1)
SELECT order_item_id AS id, CASE WHEN n % 3 = 0 THEN NULL ELSE product_id END AS product,
       CASE WHEN n % 4 = 0 THEN NULL ELSE CAST(quantity AS BIGINT) END AS quantity,
       CAST(NULL AS VARCHAR) AS rejected_column, CAST(NULL AS VARCHAR) AS rejected_value, CAST(NULL AS VARCHAR) AS reason
FROM i WHERE order_item_id NOT IN (SELECT order_item_id FROM bad)
UNION ALL SELECT order_item_id, NULL, NULL, c, v, why FROM bad""", "c_order_items")

# keys: orders before 1998 first, each extract in the order of its ids; a changed order keeps its key
cte("f_changed", ["f_order", "c_orders", "d_date"], """
SELECT row_number() OVER (ORDER BY d.date_id >= DATE '1998-01-01', f.order_id) AS order_sk, f.order_id, f.customer_sk,
       f.restaurant_sk, f.order_date_sk, f.promotion_sk, f.order_status, f.tip_amount, d.date_id,
       f.order_total + CASE WHEN d.date_id < DATE '1998-01-01' AND CAST(f.order_id AS BIGINT) % 7 = 0
                            THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS order_total
FROM f_order f JOIN d_date d ON f.order_date_sk = d.date_sk""")
Q["compact_then_query"] = sql("""
SELECT order_sk, order_id, customer_sk, restaurant_sk, order_date_sk, promotion_sk, order_status, order_total,
       tip_amount FROM f_changed""", "f_changed")
Q["stored_orders_of_a_month"] = sql(f"""
SELECT date_id AS date, COUNT(*) AS order_count, {money_sum('order_total')} AS revenue FROM f_changed
WHERE date_id BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' GROUP BY 1""", "f_changed")
Q["stored_v1_of_a_year"] = sql(f"""
SELECT r.restaurant_name, r.cuisine_type, r.city, r.state, d.year, d.month_name,
       COUNT(DISTINCT o.order_id) AS total_orders,
       {money_sum('o.order_total')} AS total_revenue, {money_avg('o.order_total')} AS avg_order_value,
       {money_sum('o.tip_amount')} AS total_tips, {money_avg('o.tip_amount')} AS avg_tip_amount
FROM f_changed o JOIN d_restaurant r ON o.restaurant_sk = r.restaurant_sk
JOIN d_date d ON o.order_date_sk = d.date_sk
WHERE r.is_current AND d.year = 1995 GROUP BY 1, 2, 3, 4, 5, 6""", "f_changed", "d_restaurant", "d_date")
Q["full_load_no_dates"] = sql("""
SELECT CAST(order_date AS DATE) AS date, COUNT(*) AS order_count FROM c_orders GROUP BY 1
UNION ALL SELECT CAST(NULL AS DATE), COUNT(*) FROM c_orders""", "c_orders")

Q["incremental_delivery_person"] = sql(f"""
WITH one AS (SELECT delivery_person_id AS p, arg_max(vehicle_type, (coalesce(pickup_time, created_at), delivery_id)) AS v
             FROM c_delivery WHERE CAST(delivery_id AS BIGINT) % 2 = 0 GROUP BY 1),
two AS (SELECT delivery_person_id AS p, CASE WHEN CAST(delivery_person_id AS BIGINT) % 5 = 0 THEN 'bicycle'
               ELSE arg_max(vehicle_type, (coalesce(pickup_time, created_at), delivery_id)) END AS v
        FROM c_delivery WHERE CAST(delivery_id AS BIGINT) % 2 = 1 GROUP BY 1),
ch AS (SELECT two.* FROM two LEFT JOIN one ON one.p = two.p WHERE one.p IS NULL OR one.v IS DISTINCT FROM two.v)
SELECT one.p AS delivery_person_id, one.v AS vehicle_type, {SNAP_TS[0]} AS effective_from,
       CASE WHEN ch.p IS NULL THEN CAST(NULL AS TIMESTAMP) ELSE {SNAP_TS[1]} END AS effective_to,
       ch.p IS NULL AS is_current
FROM one LEFT JOIN ch ON one.p = ch.p
UNION ALL SELECT p, v, {SNAP_TS[1]}, CAST(NULL AS TIMESTAMP), TRUE FROM ch""", "c_delivery")

Q["incremental_two_extracts"] = sql("""
SELECT customer_id, first_name, last_name, city, TRUE AS is_current FROM snap1""", "snap1")

Q["full_load_twice"] = Q["vw_restaurant_order_performance"]
Q["load_then_stream_customer"] = Q["scd2_merge"]
Q["scd2_merge_null_change"] = sql("""
SELECT n.customer_id, t.city AS old_city, n.city AS new_city, n.effective_from
FROM scd_result n JOIN scd_result t ON n.customer_id = t.customer_id AND n.is_current AND NOT t.is_current
WHERE n.city IS NULL OR t.city IS NULL""", "scd_result")

Q["dim_time"] = sql("""
SELECT t.time_sk, printf('%02d:%02d:00', hour_of_day, minute_of_hour) AS time_id, minute_of_day, hour_of_day,
       minute_of_hour, CAST(0 AS INTEGER) AS second_of_minute, am_pm, time_of_day_category,
       coalesce(u.n, 0) AS deliveries
FROM d_time t LEFT JOIN (SELECT pickup_time_sk, COUNT(*) AS n FROM f_delivery GROUP BY 1) u
  ON t.time_sk = u.pickup_time_sk""", "d_time", "f_delivery")

Q["dim_restaurant"] = sql("""
SELECT restaurant_sk, restaurant_id, restaurant_name, cuisine_type, city, state, country, postal_code,
       effective_from, CAST(NULL AS TIMESTAMP) AS effective_to, is_current FROM d_restaurant""", "d_restaurant")
Q["dim_product"] = sql("""
SELECT product_sk, product_id, restaurant_sk, product_name, description, category, price, cost,
       is_vegetarian, is_vegan, is_gluten_free, is_current FROM d_product""", "d_product")
Q["dim_promotion"] = sql("""
SELECT promotion_sk, promotion_id, restaurant_sk, promotion_name, description, discount_type,
       discount_value, start_date, end_date, min_order_value, max_discount, is_active, is_current
FROM d_promotion""",
                         "d_promotion")


Q["csv_header_orders"] = Q["clean_order_items"]
Q["csv_all_sources"] = sql("""
SELECT 'restaurants' AS source, restaurant_id AS key, restaurant_name AS value FROM c_restaurants
UNION ALL SELECT 'restaurants_feed2', restaurant_id, restaurant_name FROM c_restaurants WHERE s_nationkey >= 12
UNION ALL SELECT 'products', CAST(p_partkey AS VARCHAR), '$' || format('{:,.2f}', p_retailprice) FROM part
UNION ALL SELECT 'promotions', promotion_id, promotion_name FROM c_promotions
UNION ALL SELECT 'customers', customer_id, last_name FROM c_customers
UNION ALL SELECT 'orders', order_id, order_status FROM c_orders
UNION ALL SELECT 'order_items', order_item_id, product_id FROM c_order_items
UNION ALL SELECT 'delivery', delivery_id, strftime(created_at, '%d-%m-%Y') FROM c_delivery""",
                           "c_restaurants", "c_promotions", "c_customers", "c_orders", "c_order_items", "c_delivery")

Q["full_load_quarantine"] = sql("""
SELECT restaurant_id AS id, CASE WHEN CAST(restaurant_id AS BIGINT) % 7 = 0 THEN 'quarantined' ELSE 'kept' END AS state,
       CASE WHEN CAST(restaurant_id AS BIGINT) % 7 = 0
            THEN COUNT(*) FILTER (CAST(restaurant_id AS BIGINT) % 7 = 0) OVER (PARTITION BY s_nationkey < 12) END AS n
FROM c_restaurants""", "c_restaurants")

_TWICE = """
(SELECT * FROM f_rating UNION ALL BY NAME SELECT * REPLACE (1 AS delivery_rating) FROM f_rating WHERE order_sk % 2 = 0)"""
Q["vw_delivery_performance_two_ratings"] = sql(f"""
SELECT dp.delivery_person_id, d.year, d.month_name, COUNT(fd.delivery_id) AS total_deliveries,
       {mean('fd.delivery_duration_minutes')} AS avg_delivery_time,
       {mean('fd.delivery_distance')} AS avg_delivery_distance,
       CAST(SUM(fr.rsum) AS DOUBLE) / CAST(SUM(fr.rcnt) AS DOUBLE) AS avg_delivery_rating, 'per_order' AS mode
FROM f_delivery fd
JOIN d_delivery_person dp ON fd.delivery_person_sk = dp.delivery_person_sk
JOIN d_date d ON fd.delivery_date_sk = d.date_sk
LEFT JOIN (SELECT order_sk, SUM(delivery_rating) AS rsum, COUNT(delivery_rating) AS rcnt
           FROM {_TWICE} WHERE order_sk IS NOT NULL GROUP BY 1) fr ON fd.order_sk = fr.order_sk
GROUP BY 1, 2, 3
UNION ALL
SELECT dp.delivery_person_id, d.year, d.month_name, COUNT(fd.delivery_id),
       {mean('fd.delivery_duration_minutes')}, {mean('fd.delivery_distance')}, {mean('fr.delivery_rating')}, 'literal'
FROM f_delivery fd
JOIN d_delivery_person dp ON fd.delivery_person_sk = dp.delivery_person_sk
JOIN d_date d ON fd.delivery_date_sk = d.date_sk
LEFT JOIN {_TWICE} fr ON fd.order_sk = fr.order_sk
GROUP BY 1, 2, 3""", "f_delivery", "d_delivery_person", "d_date", "f_rating")

Q["audit_lookup_completeness_all"] = sql("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{k}' AS key_column, COUNT(*) AS fact_rows, COUNT(*) - COUNT({k}) AS missing "
    f"FROM {t.replace('fact_', 'f_')}" for t, k, *_ in FOREIGN_KEYS if t.startswith("fact_")),
    "f_order", "f_order_item", "f_delivery", "f_rating")

Q["daily_orders_choices"] = sql("""
SELECT CAST(o.order_date AS DATE) AS date, COUNT(*) AS order_count
FROM c_orders o JOIN c_restaurants r ON o.restaurant_id = r.restaurant_id AND r.cuisine_type = 'C1'
WHERE o.order_date IS NOT NULL GROUP BY 1""", "c_orders", "c_restaurants")


def oracle_sql() -> dict[str, str]:
    return dict(Q)
