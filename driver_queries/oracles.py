"""For each registered query, SQL that gives the same rows from the same tables."""

from __future__ import annotations

from shelfcast.operators.dictionary import ENTITY_COLUMNS, FORMAT_COLUMNS
from shelfcast.sources.contracts import FORECASTS, INVENTORY, SHIPMENTS
from shelfcast.sources.sample import PROFILES, SEED

from . import murmur_sql as m3
from .queries import (
    FORECAST_CATEGORY,
    FORECAST_FROM,
    LOW_FILL_PCT,
    MEAN_DIGITS,
    PROFILE_OF_TYPE,
)

SHIPMENTS_CTE = """shipments AS (
  SELECT 'ORD-' || lpad(l_orderkey::VARCHAR, greatest(9, length(l_orderkey::VARCHAR))::INT, '0')
           AS order_id,
         o_orderdate::DATE AS order_date,
         o_custkey::VARCHAR AS customer_id,
         l_partkey::VARCHAR AS product_sku,
         p_name AS product_name,
         p_type AS product_category,
         trunc(l_quantity)::INT AS quantity,
         p_retailprice::DECIMAL(10,2) AS unit_price,
         l_suppkey::VARCHAR AS warehouse_id,
         r_name AS destination_region,
         l_shipdate::DATE AS delivery_date,
         CASE WHEN o_orderstatus = 'P' AND l_returnflag = 'R' THEN 'Cancelled'
              WHEN o_orderstatus = 'P' THEN 'Backorder'
              WHEN o_orderstatus = 'O' AND l_linestatus = 'O' THEN 'In Transit'
              ELSE 'Delivered' END AS order_status
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
)"""

INVENTORY_CTE = """inventory AS (
  SELECT p_partkey::VARCHAR AS product_sku, p_name AS product_name,
         p_type AS product_category, s_suppkey::VARCHAR AS warehouse_id,
         s_name AS warehouse_name, DATE '2001-06-06' + (7 * w)::INT AS snapshot_date,
         ((31 * p_partkey + 17 * s_suppkey + 13 * w) % (4 * (20 + 4 * p_size)))::INT
           AS quantity_on_hand,
         20 + 4 * p_size AS reorder_point, 10 + 2 * p_size AS safety_stock_qty,
         (4 + s_suppkey % 4)::INT AS lead_time_days,
         p_retailprice::DECIMAL(10,2) AS unit_cost
  FROM part
  CROSS JOIN range(0, 4) AS store(i)
  CROSS JOIN range(0, 8) AS week(w)
  JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS store_number
        FROM supplier WHERE s_suppkey IS NOT NULL) AS stores
    ON store_number = (p_partkey + i * ((SELECT count(s_suppkey) FROM supplier) // 4))
                      % (SELECT count(s_suppkey) FROM supplier)
), latest AS (
  SELECT * FROM inventory WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory)
)"""

FORECASTS_CTE = """monthly AS (
  SELECT p_brand || '/' || p_type AS product_sku, p_type AS product_category,
         r_name AS region, r_regionkey, date_trunc('month', o_orderdate)::DATE AS forecast_date,
         sum(l_quantity)::INT AS actual_demand
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
), predicted AS (
  SELECT *, (actual_demand::BIGINT
             * (88 + (7 * month(forecast_date) + 5 * r_regionkey) % 25) // 100)::INT
             AS predicted_demand
  FROM monthly
), forecasts AS (
  SELECT product_sku, product_sku AS product_name, product_category, forecast_date,
         predicted_demand,
         (predicted_demand::BIGINT * 83 // 100)::INT AS confidence_lower,
         (predicted_demand::BIGINT * 115 // 100)::INT AS confidence_upper,
         actual_demand,
         round(abs(actual_demand - predicted_demand)::DOUBLE / nullif(actual_demand, 0) * 100, 1)
           AS forecast_error_pct,
         CASE WHEN month(forecast_date) <= 4 THEN 'v3.0'
              WHEN month(forecast_date) <= 8 THEN 'v3.1' ELSE 'v3.2' END AS model_version,
         region
  FROM predicted
)"""

DEMAND_CTE = """daily_demand AS (
  SELECT product_sku, warehouse_id,
         sum(quantity)::DOUBLE
           / nullif(date_diff('day', min(order_date), max(order_date)), 0) AS avg_daily_demand
  FROM shipments WHERE order_status = 'Delivered'
  GROUP BY product_sku, warehouse_id
), supply AS (
  SELECT latest.*, quantity_on_hand / nullif(avg_daily_demand, 0) AS days_of_supply
  FROM latest LEFT JOIN daily_demand USING (product_sku, warehouse_id)
)"""

SHIPMENT_MEASURES = """
  (sum(quantity) FILTER (WHERE order_status = 'Delivered'))::BIGINT AS total_units_shipped,
  (sum(quantity * unit_price) FILTER (WHERE order_status = 'Delivered'))::DECIMAL(38,2)
    AS total_revenue,
  count(DISTINCT order_id) AS total_orders,
  count(DISTINCT order_id) FILTER (WHERE order_status = 'Delivered') AS delivered_orders,
  count(DISTINCT CASE WHEN order_status = 'Delivered' THEN order_id END)::DOUBLE * 100
    / nullif(count(DISTINCT order_id), 0) AS fill_rate,
  sum(CASE WHEN order_status = 'Delivered' THEN quantity ELSE 0 END)::DOUBLE
    / nullif(count(DISTINCT CASE WHEN order_status = 'Delivered' THEN order_id END), 0)
    AS avg_order_size"""

INVENTORY_MEASURES = """
  sum(quantity_on_hand)::BIGINT AS total_quantity_on_hand,
  sum(quantity_on_hand * unit_cost)::DECIMAL(38,2) AS total_inventory_value,
  count(*) FILTER (WHERE quantity_on_hand <= reorder_point) AS skus_below_reorder_point,
  count(*) FILTER (WHERE quantity_on_hand < safety_stock_qty) AS skus_below_safety_stock,
  sum(lead_time_days)::DOUBLE / count(lead_time_days) AS avg_lead_time"""

FORECAST_MEASURES = f"""
  sum(predicted_demand)::BIGINT AS total_predicted_demand,
  sum(actual_demand)::BIGINT AS total_actual_demand,
  round(avg(forecast_error_pct), {MEAN_DIGITS}) AS avg_forecast_error,
  round(avg(100 - forecast_error_pct), {MEAN_DIGITS}) AS avg_forecast_accuracy,
  sum(actual_demand - predicted_demand)::BIGINT AS demand_variance,
  count(*) AS forecast_count"""


def _on_shipments(select: str) -> str:
    return f"WITH {SHIPMENTS_CTE}\n{select}"


def _on_inventory(select: str) -> str:
    return f"WITH {INVENTORY_CTE}\n{select}"


def _on_forecasts(select: str) -> str:
    return f"WITH {FORECASTS_CTE}\n{select}"


def _on_supply(select: str) -> str:
    return f"WITH {SHIPMENTS_CTE}, {INVENTORY_CTE}, {DEMAND_CTE}\n{select}"


def _shipment_metrics(*by: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    grouped = "\nGROUP BY ALL" if by else ""
    return _on_shipments(f"SELECT {keys}{SHIPMENT_MEASURES}\nFROM shipments{grouped}")


def _dictionary(cte: str, table: str, columns: tuple[str, ...]) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS row_count "
        f"FROM {table} WHERE {c} IS NOT NULL GROUP BY ALL"
        for c in columns
    ]
    return f"WITH {cte}\n" + "\nUNION ALL\n".join(parts)


def _top_values(cte: str, table: str, columns: tuple[str, ...], k: int) -> str:
    return (
        f"SELECT * FROM ({_dictionary(cte, table, columns)}) AS counted\n"
        f"QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY row_count DESC, value) <= {k}"
    )


def _format_profile(cte: str, table: str, columns: tuple[str, ...], types: dict) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, '{types[c]}' AS type, min({c})::VARCHAR AS min_value, "
        f"max({c})::VARCHAR AS max_value, count({c}) AS row_count FROM {table}"
        for c in columns
    ]
    return f"WITH {cte}\n" + "\nUNION ALL\n".join(parts)


# --- generators ---

GEN_DIMS_CTE = f"""products AS MATERIALIZED (
  SELECT *, {m3.words('product_sku')} AS sku_words, length(product_sku) AS sku_length
  FROM (SELECT p_partkey::VARCHAR AS product_sku, p_name AS product_name,
               p_type AS product_category, p_retailprice::DECIMAL(10,2) AS unit_price,
               20 + 4 * p_size AS reorder_point, 10 + 2 * p_size AS safety_stock_qty
        FROM part)
), warehouses AS MATERIALIZED (
  SELECT *, {m3.words('warehouse_id')} AS wh_words, length(warehouse_id) AS wh_length,
         {m3.words('region')} AS region_words, length(region) AS region_length
  FROM (SELECT 'DC-' || r_regionkey AS warehouse_id, r_name || ' DC' AS warehouse_name,
               r_name AS region, (4 + count(*) % 4)::INT AS lead_time_days
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_regionkey, r_name)
)"""


def _by_profile(value, default) -> str:
    """CASE over the categories; ``value(profile)`` is the SQL of one of them."""
    arms = " ".join(
        f"WHEN '{PROFILE_OF_TYPE[p.category]}' THEN {value(p)}"
        for p in PROFILES
        if p.category is not None
    )
    fallback = next(p for p in PROFILES if p.category is None)
    return f"CASE product_category {arms} ELSE {default(fallback)} END"


def _seasonal(field: str, month: str, cast: str) -> str:
    def arm(profile) -> str:
        season = getattr(profile, field)
        whens = " ".join(
            f"WHEN {month} IN ({', '.join(map(str, months))}) THEN {value}::{cast}"
            for months, value in season.peaks
        )
        usual = f"{season.usual}::{cast}"
        return f"(CASE {whens} ELSE {usual} END)" if whens else usual

    return _by_profile(arm, arm)


def _noise(salts: list[str], date: str, modulo: dict[str, int], third: str) -> str:
    """One bucket column per salt over (date, product, ``third``) of a joined row."""
    return ", ".join(
        m3.bucket(
            m3.add_words(
                m3.add_words(
                    m3.add_date(m3.start(SEED, salt), date), "sku_words", "sku_length"
                ),
                f"{third}_words",
                f"{third}_length",
            ),
            modulo.get(salt, 10000),
        )
        + f" AS {salt}"
        for salt in salts
    )


def _pair_bucket(salt: str, third: str) -> str:
    state = m3.add_words(m3.start(SEED, salt), "sku_words", "sku_length")
    return m3.bucket(m3.add_words(state, f"{third}_words", f"{third}_length"), 100)


QUANTITY = _by_profile(
    lambda p: f"{p.quantity[0]} + floor(qty_noise / 10000.0::DOUBLE * {p.quantity[1]})",
    lambda p: f"{p.quantity[0]} + floor(qty_noise / 10000.0::DOUBLE * {p.quantity[1]})",
)

_selected = m3.bucket(
    m3.add_words(
        m3.add_words("day_state", "sku_words", "sku_length"), "wh_words", "wh_length"
    ),
    10000,
)


def _gen_shipments(first: str) -> str:
    return f"""WITH {GEN_DIMS_CTE}, days AS MATERIALIZED (
  SELECT order_date, {m3.add_date(m3.start(SEED, 'select_noise'), 'order_date')} AS day_state
  FROM (SELECT unnest(generate_series(DATE '{first}', DATE '2025-12-31',
                                      INTERVAL 1 DAY))::DATE AS order_date)
  WHERE dayofweek(order_date) BETWEEN 1 AND 5
), sold AS (
  SELECT *, month(order_date) AS mo
  FROM days CROSS JOIN products CROSS JOIN warehouses
  WHERE {_selected} / 10000.0::DOUBLE < {_seasonal('order_rate', 'month(order_date)', 'DOUBLE')}
), noisy AS (
  SELECT *, {_noise(['customer_idx', 'qty_noise', 'status_noise', 'delivery_offset'],
                    'order_date', {'customer_idx': 500, 'delivery_offset': 4}, 'wh')},
         10000 + row_number() OVER (ORDER BY order_date, product_sku, warehouse_id) AS number
  FROM sold
)
SELECT 'ORD-' || lpad(number::VARCHAR, greatest(6, length(number::VARCHAR))::INT, '0') AS order_id,
       order_date,
       'CUST-' || (1001 + customer_idx)::VARCHAR AS customer_id,
       product_sku, product_name, product_category,
       ({QUANTITY})::INT AS quantity,
       unit_price, warehouse_id, region AS destination_region,
       order_date + (2 + delivery_offset)::INT AS delivery_date,
       CASE WHEN status_noise < 200 THEN 'Cancelled'
            WHEN status_noise < 500 THEN 'Backorder'
            WHEN status_noise < 800 AND order_date > DATE '2025-11-15' THEN 'In Transit'
            ELSE 'Delivered' END AS order_status
FROM noisy"""


# The wave's angle is decimal: rounded half up to ten digits before the phase is added.
_phase = m3.bucket(
    m3.add_words(f"{m3.SPARK_SEED}::UBIGINT", "sku_words", "sku_length"), 100
)
_angle = (
    "((dayofyear(snapshot_date)::BIGINT * 31415900000 + 90) // 180 "
    "+ phase * 10000000000)::DOUBLE / 10000000000"
)


def _gen_inventory(first: str) -> str:
    return f"""WITH {GEN_DIMS_CTE}, pairs AS MATERIALIZED (
  SELECT *, {_phase} AS phase FROM products CROSS JOIN warehouses
  WHERE {_pair_bucket('inventory_pair', 'wh')} < 52
), noisy AS (
  SELECT *, {_noise(['inventory_noise', 'lead_delta'], 'snapshot_date', {'lead_delta': 3}, 'wh')},
         {_angle} AS angle,
         {_seasonal('stock_dip', 'month(snapshot_date)', 'DECIMAL(2,1)')} AS dip
  FROM pairs CROSS JOIN (
    SELECT unnest(generate_series(DATE '{first}', DATE '2025-12-31',
                                  INTERVAL 7 DAY))::DATE AS snapshot_date)
)
SELECT product_sku, product_name, product_category, warehouse_id, warehouse_name, snapshot_date,
       greatest(0, trunc(
         (reorder_point * 1.8)::DOUBLE
         + (reorder_point * 0.6)::DOUBLE * sin(angle)
         + (reorder_point * 0.3)::DOUBLE
           * (inventory_noise / 10000.0::DOUBLE - 0.5::DOUBLE)
         - (reorder_point * dip)::DOUBLE)::INT) AS quantity_on_hand,
       reorder_point, safety_stock_qty,
       (lead_time_days + lead_delta - 1)::INT AS lead_time_days,
       unit_price AS unit_cost
FROM noisy"""


def _scaled(units: str, low: str, width: str, salt: str) -> str:
    share = f"({low}::DOUBLE + {width}::DOUBLE * ({salt} / 10000.0::DOUBLE))"
    return f"trunc({units}::DOUBLE * {share})::INT"


_base = _by_profile(lambda p: str(p.demand), lambda p: str(p.demand))
_season = _seasonal("demand_season", "month(forecast_date)", "DECIMAL(2,1)")


def _gen_forecasts(first: str) -> str:
    return f"""WITH {GEN_DIMS_CTE}, pairs AS MATERIALIZED (
  SELECT * FROM products
  CROSS JOIN (SELECT DISTINCT region, region_words, region_length FROM warehouses)
  WHERE {_pair_bucket('forecast_pair', 'region')} < 52
), noisy AS (
  SELECT *, {_noise(['forecast_noise', 'lower_noise', 'upper_noise', 'actual_noise'],
                    'forecast_date', {}, 'region')}
  FROM pairs CROSS JOIN (
    SELECT unnest(generate_series(DATE '{first}', DATE '2025-12-01',
                                  INTERVAL 1 MONTH))::DATE AS forecast_date)
), predicted AS (
  SELECT *, {_scaled(f"({_base} * (1.0 + 0.03 * month(forecast_date)) * {_season})",
                     '0.85', '0.30', 'forecast_noise')} AS predicted_demand
  FROM noisy
), filled AS (
  SELECT *, {_scaled('predicted_demand', '0.82', '0.03', 'lower_noise')} AS confidence_lower,
         {_scaled('predicted_demand', '1.12', '0.05', 'upper_noise')} AS confidence_upper,
         {_scaled('predicted_demand', '0.88', '0.24', 'actual_noise')} AS actual_demand
  FROM predicted
)
SELECT product_sku, product_name, product_category, forecast_date, predicted_demand,
       confidence_lower, confidence_upper, actual_demand,
       round(abs(actual_demand - predicted_demand)::DOUBLE / nullif(actual_demand, 0) * 100, 1)
         AS forecast_error_pct,
       CASE WHEN month(forecast_date) <= 4 THEN 'v3.0'
            WHEN month(forecast_date) <= 8 THEN 'v3.1' ELSE 'v3.2' END AS model_version,
       region
FROM filled"""


def _difference(name: str, actual: str, expected: str) -> str:
    missing = f"(SELECT count(*) FROM ({expected} EXCEPT ALL {actual}))"
    extra = f"(SELECT count(*) FROM ({actual} EXCEPT ALL {expected}))"
    return (
        f"SELECT '{name}' AS question, {missing} AS missing_rows, {extra} AS extra_rows, "
        f"{missing} = 0 AND {extra} = 0 AS matches"
    )


_VOLUME = (
    "SELECT warehouse_id, sum(quantity) AS total_shipped FROM shipments "
    "WHERE order_status = 'Delivered' GROUP BY warehouse_id"
)
_VOLUME_OF_ALL = (
    "SELECT warehouse_id, sum(quantity) AS total_shipped FROM shipments GROUP BY warehouse_id"
)
_BRIEF = (
    "SELECT product_sku, product_name, warehouse_id, warehouse_name, quantity_on_hand, "
    "reorder_point FROM latest WHERE quantity_on_hand <= reorder_point"
)

_LEAD = (
    "SELECT product_sku, product_name, warehouse_name, quantity_on_hand, reorder_point, "
    "lead_time_days FROM latest WHERE quantity_on_hand <= reorder_point"
)
_VALUE = (
    "SELECT warehouse_id, warehouse_name, "
    "round(sum(quantity_on_hand * unit_cost), 2)::DECIMAL(38,2) AS total_value "
    "FROM latest GROUP BY 1, 2"
)
_ACCURACY = (
    "SELECT product_category, round(avg(100 - forecast_error_pct), 1) AS accuracy_pct "
    "FROM forecasts GROUP BY 1"
)
_FILL = (
    "SELECT product_category, "
    "count(DISTINCT CASE WHEN order_status = 'Delivered' THEN order_id END)::DOUBLE * 100 "
    "/ nullif(count(DISTINCT order_id), 0) AS fill_rate "
    "FROM shipments GROUP BY product_category"
)
_REVENUE = (
    "SELECT destination_region, (sum(quantity * unit_price) "
    "FILTER (WHERE order_status = 'Delivered'))::DECIMAL(38,2) AS total_revenue "
    "FROM shipments GROUP BY destination_region"
)


def _checks(*differences: str) -> str:
    ctes = ", ".join([SHIPMENTS_CTE, INVENTORY_CTE, FORECASTS_CTE])
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join(differences)


# The same questions answered in another way, so that a check compares two statements.
_VOLUME_AGAIN = (
    "SELECT warehouse_id, total_shipped FROM (SELECT warehouse_id, sum(CASE WHEN order_status = "
    "'Delivered' THEN quantity END) AS total_shipped FROM shipments GROUP BY 1) "
    "WHERE total_shipped IS NOT NULL"
)
_FILL_AGAIN = (
    "SELECT product_category, sum(delivered)::DOUBLE * 100 / count(*) AS fill_rate FROM ("
    "SELECT product_category, order_id, max(CASE WHEN order_status = 'Delivered' THEN 1 ELSE 0 END) "
    "AS delivered FROM shipments WHERE order_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
)
_REVENUE_AGAIN = (
    "SELECT destination_region, sum(amount)::DECIMAL(38,2) AS total_revenue FROM ("
    "SELECT destination_region, order_date, sum(CASE WHEN order_status = 'Delivered' THEN "
    "quantity * unit_price END) AS amount FROM shipments GROUP BY 1, 2) GROUP BY 1"
)
_BRIEF_AGAIN = (
    "SELECT product_sku, product_name, warehouse_id, warehouse_name, quantity_on_hand, "
    "reorder_point FROM inventory WHERE snapshot_date = DATE '2001-07-25' "
    "AND NOT quantity_on_hand > reorder_point"
)
_VALUE_AGAIN = (
    "SELECT warehouse_id, warehouse_name, sum(v)::DECIMAL(38,2) AS total_value FROM ("
    "SELECT warehouse_id, warehouse_name, product_sku, sum(quantity_on_hand * unit_cost) AS v "
    "FROM latest GROUP BY 1, 2, 3) GROUP BY 1, 2"
)
_LEAD_AGAIN = (
    "SELECT product_sku, product_name, warehouse_name, quantity_on_hand, reorder_point, "
    "lead_time_days FROM latest EXCEPT ALL SELECT product_sku, product_name, warehouse_name, "
    "quantity_on_hand, reorder_point, lead_time_days FROM latest WHERE quantity_on_hand > reorder_point"
)
_ACCURACY_AGAIN = (
    "SELECT product_category, round(100 - sum(forecast_error_pct) / count(forecast_error_pct), 1) "
    "AS accuracy_pct FROM forecasts GROUP BY 1"
)
_shipment_types = {f.name: f.type for f in SHIPMENTS.fields}

ORACLES: dict[str, str] = {
    "fill_rate_by_category": _on_shipments(_FILL),
    "revenue_by_region": _on_shipments(_REVENUE),
    "rollup_fill_rate_by_category": _on_shipments(_FILL),
    "rollup_metrics_by_month": _on_shipments(
        "SELECT date_trunc('month', order_date)::DATE AS order_month, "
        f"{SHIPMENT_MEASURES}\nFROM shipments GROUP BY 1"
    ),
    "shipment_metrics_by_month": _on_shipments(
        "SELECT date_trunc('month', order_date)::DATE AS order_month, "
        f"{SHIPMENT_MEASURES}\nFROM shipments GROUP BY 1"
    ),
    "shipment_metrics_global": _shipment_metrics(),
    "shipment_metrics_by_product": _shipment_metrics("product_sku", "product_name"),
    "shipment_metrics_by_day_and_status": _shipment_metrics("order_date", "order_status"),
    "gross_volume_by_quarter": _on_shipments(
        "SELECT date_trunc('quarter', order_date)::DATE AS order_quarter, "
        "sum(quantity)::BIGINT AS gross_units, "
        "sum(quantity * unit_price)::DECIMAL(38,2) AS gross_revenue FROM shipments GROUP BY 1"
    ),
    "delivered_volume_by_month": _on_shipments(
        "SELECT date_trunc('month', order_date)::DATE AS order_month, "
        "sum(quantity)::BIGINT AS gross_units, "
        "sum(quantity * unit_price)::DECIMAL(38,2) AS gross_revenue FROM shipments "
        "WHERE order_status = 'Delivered' GROUP BY 1"
    ),
    "low_fill_rate_warehouses": _on_shipments(
        "SELECT warehouse_id, "
        "count(DISTINCT CASE WHEN order_status = 'Delivered' THEN order_id END)::DOUBLE * 100 "
        "/ nullif(count(DISTINCT order_id), 0) AS fill_rate "
        f"FROM shipments GROUP BY warehouse_id HAVING fill_rate < {LOW_FILL_PCT}"
    ),
    "volume_by_warehouse": _on_shipments(
        "SELECT warehouse_id, sum(quantity)::BIGINT AS total_shipped FROM shipments "
        "WHERE order_status = 'Delivered' GROUP BY warehouse_id"
    ),
    "volume_last_3_months": _on_shipments(
        "SELECT warehouse_id, sum(quantity)::BIGINT AS total_units_shipped, "
        "count(DISTINCT order_id) AS total_orders FROM shipments "
        "WHERE order_date >= (SELECT max(order_date) - INTERVAL 3 MONTH FROM shipments)::DATE "
        "AND order_status = 'Delivered' GROUP BY warehouse_id"
    ),
    "inventory_metrics_by_warehouse": _on_inventory(
        f"SELECT warehouse_id, warehouse_name, {INVENTORY_MEASURES}\nFROM inventory GROUP BY 1, 2"
    ),
    "inventory_metrics_latest": _on_inventory(
        f"SELECT product_category, {INVENTORY_MEASURES}\nFROM latest GROUP BY 1"
    ),
    "inventory_metrics_by_snapshot": _on_inventory(
        f"SELECT snapshot_date, product_category, {INVENTORY_MEASURES}\n"
        "FROM inventory GROUP BY 1, 2"
    ),
    "inventory_value_by_product": _on_inventory(
        "SELECT product_sku, product_name, "
        "sum(quantity_on_hand * unit_cost)::DECIMAL(38,2) AS total_inventory_value "
        "FROM latest GROUP BY 1, 2"
    ),
    "below_reorder": _on_inventory(
        "SELECT product_sku, product_name, warehouse_id, warehouse_name, quantity_on_hand, "
        "reorder_point, safety_stock_qty, "
        "CASE WHEN quantity_on_hand < safety_stock_qty THEN 'CRITICAL' "
        "WHEN quantity_on_hand <= reorder_point THEN 'LOW' ELSE 'HEALTHY' END AS stock_status "
        "FROM latest WHERE quantity_on_hand <= reorder_point"
    ),
    "below_reorder_brief": _on_inventory(_BRIEF),
    "reorder_by_lead_time": _on_inventory(_LEAD),
    "stock_status_counts": _on_inventory(
        "SELECT snapshot_date, "
        "CASE WHEN quantity_on_hand < safety_stock_qty THEN 'CRITICAL' "
        "WHEN quantity_on_hand <= reorder_point THEN 'LOW' ELSE 'HEALTHY' END AS status_3, "
        "CASE WHEN quantity_on_hand < safety_stock_qty THEN 'Critical' "
        "WHEN quantity_on_hand <= reorder_point THEN 'Low' "
        "WHEN quantity_on_hand <= reorder_point * 2 THEN 'Healthy' "
        "ELSE 'Overstocked' END AS status_4, "
        "count(*) AS row_count, "
        "count(*) FILTER (WHERE quantity_on_hand <= reorder_point) AS low_rows, "
        "count(*) FILTER (WHERE quantity_on_hand < safety_stock_qty) AS critical_rows "
        "FROM inventory GROUP BY 1, 2, 3"
    ),
    "inventory_value_by_warehouse": _on_inventory(_VALUE),
    "days_of_supply_by_category": _on_supply(
        "SELECT product_category, round(avg(days_of_supply), 1) AS avg_days_of_supply "
        "FROM supply GROUP BY 1"
    ),
    "stockout_risk": _on_supply(
        "SELECT product_sku, product_name, warehouse_id, warehouse_name, quantity_on_hand, "
        "safety_stock_qty, lead_time_days, days_of_supply FROM supply "
        "WHERE quantity_on_hand < safety_stock_qty OR days_of_supply < lead_time_days"
    ),
    "forecast_accuracy_by_category": _on_forecasts(
        "SELECT product_category, round(avg(100 - forecast_error_pct), 1) AS avg_accuracy_pct, "
        "round(avg(forecast_error_pct), 1) AS avg_error_pct, count(*) AS num_forecasts "
        "FROM forecasts GROUP BY 1"
    ),
    "forecast_accuracy_brief": _on_forecasts(_ACCURACY),
    "forecast_metrics_by_model": _on_forecasts(
        f"SELECT model_version, {FORECAST_MEASURES}\nFROM forecasts GROUP BY 1"
    ),
    "forecast_metrics_by_region_and_month": _on_forecasts(
        f"SELECT region, forecast_date, {FORECAST_MEASURES}\nFROM forecasts GROUP BY 1, 2"
    ),
    "forecast_accuracy_by_product": _on_forecasts(
        "SELECT product_sku, round(avg(100 - forecast_error_pct), 1) AS avg_forecast_accuracy "
        "FROM forecasts GROUP BY 1"
    ),
    "actual_vs_forecast": _on_forecasts(
        "SELECT product_name, forecast_date, predicted_demand, actual_demand, "
        "actual_demand - predicted_demand AS variance, "
        "round(100 - forecast_error_pct, 1) AS accuracy_pct, model_version, region "
        f"FROM forecasts WHERE product_category = '{FORECAST_CATEGORY}' "
        f"AND forecast_date >= DATE '{FORECAST_FROM}'"
    ),
    "forecast_table": _on_forecasts("SELECT * FROM forecasts"),
    "gen_shipments": _gen_shipments("2025-01-01"),
    "gen_inventory": _gen_inventory("2025-01-01"),
    "gen_forecasts": _gen_forecasts("2025-01-01"),
    "gen_shipments_two_years": _gen_shipments("2024-01-01"),
    "gen_inventory_two_years": _gen_inventory("2024-01-01"),
    "gen_forecasts_two_years": _gen_forecasts("2024-01-01"),
    "warehouse_regions": (
        "SELECT DISTINCT r_name AS region FROM supplier "
        "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    ),
    "value_dictionary": _dictionary(
        SHIPMENTS_CTE, "shipments", ENTITY_COLUMNS[SHIPMENTS.table]
    ),
    "value_dictionary_inventory": _dictionary(
        INVENTORY_CTE, "inventory", ENTITY_COLUMNS[INVENTORY.table]
    ),
    "top_values_shipments": _top_values(
        SHIPMENTS_CTE, "shipments", ("order_id", "customer_id", "product_sku", "warehouse_id"), 10
    ),
    "value_dictionary_forecasts": _dictionary(
        FORECASTS_CTE, "forecasts", ENTITY_COLUMNS[FORECASTS.table]
    ),
    "format_profile_shipments": _format_profile(
        SHIPMENTS_CTE, "shipments", FORMAT_COLUMNS[SHIPMENTS.table], _shipment_types
    ),
    "format_profile_inventory": _format_profile(
        INVENTORY_CTE, "inventory", FORMAT_COLUMNS[INVENTORY.table],
        {f.name: f.type for f in INVENTORY.fields},
    ),
    "format_profile_forecasts": _format_profile(
        FORECASTS_CTE, "forecasts", FORMAT_COLUMNS[FORECASTS.table],
        {f.name: f.type for f in FORECASTS.fields},
    ),
    "fill_rate_in_months": _on_shipments(
        "SELECT product_category, "
        "count(DISTINCT CASE WHEN order_status = 'Delivered' THEN order_id END)::DOUBLE * 100 "
        "/ nullif(count(DISTINCT order_id), 0) AS fill_rate, "
        "count(DISTINCT order_id) AS total_orders "
        "FROM shipments WHERE order_date >= DATE '1995-03-01' AND order_date < DATE '1996-03-01' "
        "GROUP BY product_category"
    ),
    "answer_check_near_miss": _on_supply(
        "SELECT 'volume_by_warehouse' AS question, count(*) AS missing_rows, count(*) AS extra_rows, "
        f"false AS matches FROM ({_VOLUME}) UNION ALL "
        f"SELECT 'fill_rate_by_category', 0, count(*), false FROM ({_FILL}) UNION ALL "
        f"SELECT 'inventory_value_by_warehouse', count(*), count(*), false FROM ({_VALUE})"
    ),
    "answer_check": _checks(
        _difference("volume_by_warehouse", _VOLUME_AGAIN, _VOLUME),
        _difference("fill_rate_by_category", _FILL_AGAIN, _FILL),
        _difference("revenue_by_region", _REVENUE_AGAIN, _REVENUE),
    ),
    "answer_check_inventory": _checks(
        _difference("below_reorder_brief", _BRIEF_AGAIN, _BRIEF),
        _difference("inventory_value_by_warehouse", _VALUE_AGAIN, _VALUE),
        _difference("reorder_by_lead_time", _LEAD_AGAIN, _LEAD),
    ),
    "answer_check_forecasts": _checks(
        _difference("forecast_accuracy_brief", _ACCURACY_AGAIN, _ACCURACY),
    ),
    "answer_check_exact": (
        "WITH sums AS (SELECT l_suppkey, sum(l_quantity::BIGINT) AS units FROM lineitem GROUP BY 1) "
        "SELECT 'whole_as_double' AS question, count(*) FILTER (WHERE units % 2 = 1) AS missing_rows, "
        "count(*) FILTER (WHERE units % 2 = 1) AS extra_rows, count(*) FILTER (WHERE units % 2 = 1) = 0 AS matches FROM sums "
        "UNION ALL SELECT 'two_cents_off', count(*), count(*), false FROM sums "
        "UNION ALL SELECT 'more_places', 0, 0, true"
    ),
    "inventory_month_end": _on_inventory(
        f"SELECT date_trunc('month', snapshot_date)::DATE AS snapshot_month, warehouse_id, {INVENTORY_MEASURES}\n"
        "FROM inventory JOIN (SELECT date_trunc('month', snapshot_date) AS m, warehouse_id AS w, "
        "max(snapshot_date) AS last FROM inventory GROUP BY 1, 2) ON w = warehouse_id AND last = snapshot_date GROUP BY 1, 2"
    ),
    "answer_check_wrong": _checks(
        _difference("volume_by_warehouse", _VOLUME_OF_ALL, _VOLUME),
        _difference("below_reorder_brief", _BRIEF.replace("FROM latest", "FROM inventory"), _BRIEF),
        _difference("fill_rate_by_category", _FILL.replace("DISTINCT ", ""), _FILL),
    ),
}
ORACLES |= {
    "sql_low_fill_rate": ORACLES["low_fill_rate_warehouses"],
    "sql_recent_volume": ORACLES["volume_last_3_months"],
    "sql_actual_vs_forecast": ORACLES["actual_vs_forecast"],
    "sql_stockout_risk": ORACLES["stockout_risk"],
}

ORACLES["answer_order"] = " UNION ALL ".join(
    f"SELECT '{name}' AS question, count(*) AS n_rows, 0::BIGINT AS out_of_order FROM ({ORACLES[name]})"
    for name in (
        "below_reorder", "below_reorder_brief", "reorder_by_lead_time", "revenue_by_region",
        "fill_rate_by_category", "actual_vs_forecast",
    )
)
