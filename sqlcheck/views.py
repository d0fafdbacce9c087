"""DuckDB text of the stand-in inputs (twins of ``retailspark.sources.fixtures``).

``with_views(names, body)`` prefixes a query with the CTEs it needs, so every
oracle statement runs on the raw driver tables only.
"""

from __future__ import annotations

AS_OF = "DATE '2001-07-01'"
EVENTS_AS_OF = "DATE '2024-02-15'"

_WMO_CASE = (
    "CASE CAST(l.l_orderkey % 12 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 45 "
    "WHEN 5 THEN 51 WHEN 6 THEN 63 WHEN 7 THEN 67 WHEN 8 THEN 80 WHEN 9 THEN 95 WHEN 10 THEN 99 ELSE NULL END"
)

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "sales": (
        f"""SELECT CAST(l.l_suppkey + 1 AS INT) AS store_id, p.p_brand AS barcode, CAST(l.l_shipdate AS DATE) AS sale_date,
  printf('%02d:%02d:%02d', CAST(7 + l.l_orderkey % 15 AS INT), CAST((l.l_linenumber * 7) % 60 AS INT), CAST((l.l_orderkey * 13) % 60 AS INT)) AS time,
  CAST(l.l_quantity AS INT) AS amount,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE CAST(l.l_partkey % 60 AS DOUBLE) / 2.0 END AS temperature,
  {_WMO_CASE} AS weather_resume_wmo_code
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
        (),
    ),
    "stores": (
        """SELECT CAST(s_suppkey + 1 AS INT) AS store_id, s_name AS owner_name,
  CASE CAST(s_suppkey % 10 AS INT) WHEN 3 THEN '   ' WHEN 4 THEN NULL
    WHEN 7 THEN concat('store', CAST(CAST(s_suppkey + 1 AS INT) AS VARCHAR), '.example.com')
    ELSE concat(' store', CAST(CAST(s_suppkey + 1 AS INT) AS VARCHAR), '@example.com ') END AS email,
  CASE s_nationkey % 5 WHEN 0 THEN 'Guadalajara' WHEN 1 THEN 'Ciudad de México' WHEN 2 THEN 'Monterrey' WHEN 3 THEN 'Puebla'
    ELSE 'Cancún' END AS city,
  15.0 + CAST(s_nationkey AS DOUBLE) / 2.0 AS latitude, -105.0 + CAST(s_nationkey AS DOUBLE) / 4.0 AS longitude
FROM supplier""",
        (),
    ),
    "products": (
        """SELECT barcode,
  CASE brand_no % 4 WHEN 0 THEN concat('Café ', CAST(brand_no AS VARCHAR)) WHEN 1 THEN concat('Jabón ', CAST(brand_no AS VARCHAR))
    WHEN 2 THEN concat('Ñandú ', CAST(brand_no AS VARCHAR)) ELSE NULL END AS product_name,
  CASE brand_no % 6 WHEN 0 THEN 'Beverages' WHEN 1 THEN 'Snacks' WHEN 2 THEN 'Dairy' WHEN 3 THEN 'Cleaning' WHEN 4 THEN 'Sweets' ELSE NULL END AS category,
  concat('https://img.example.com/', CAST(brand_no AS VARCHAR), '.jpg') AS image_url, brand_no
FROM (SELECT DISTINCT p_brand AS barcode, CAST(substr(p_brand, 7) AS INT) AS brand_no FROM part) b""",
        (),
    ),
    "forecast_payloads": (
        f"""SELECT store_id, {AS_OF} AS start_date,
  list_transform(range(7), lambda i: 24.0 + CAST(store_id % 5 AS DOUBLE) + CAST(i AS DOUBLE) / 2.0) AS temperature_2m_max,
  list_transform(range(7), lambda i: 12.0 + CAST(store_id % 3 AS DOUBLE) + CAST(i AS DOUBLE) / 4.0) AS temperature_2m_min,
  list_transform(range(7), lambda i: CASE (store_id + i) % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 61 ELSE 95 END) AS weather_code
FROM stores WHERE store_id % 7 <> 0""",
        ("stores",),
    ),
    "predictions": (
        f"""SELECT store_id, barcode, product_name, category, image_url, objective_date, prediction, type <> 'none' AS feature, type,
  CASE WHEN (store_id + brand_no + day_no) % 29 = 0 THEN NULL ELSE dev END AS percentage_average_deviation
FROM (SELECT *, CASE WHEN dev <= -15.0 THEN 'deficit' WHEN dev >= 15.0 THEN 'superavit' ELSE 'none' END AS type
  FROM (SELECT *, CASE WHEN v_p > 0 THEN (CAST(prediction AS DOUBLE) - v_p) / v_p * 100.0
                       WHEN prediction > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0.0 END AS dev
    FROM (SELECT a.store_id, a.barcode, pr.product_name, pr.category, pr.image_url, pr.brand_no, d.day_no,
            CAST({AS_OF} + CAST(d.day_no AS INT) AS DATE) AS objective_date, COALESCE(r.v_p, 0.0) AS v_p,
            CAST(FLOOR(a.v_all * (CAST(60 + (a.store_id * 7 + pr.brand_no * 3 + (d.day_no + 1) * 5) % 80 AS DOUBLE) / 100.0)) AS INT) AS prediction
          FROM (SELECT store_id, barcode, AVG(CAST(daily_total AS DOUBLE)) AS v_all FROM pdaily GROUP BY store_id, barcode) a
          LEFT JOIN (SELECT store_id, barcode, AVG(CAST(daily_total AS DOUBLE)) AS v_p FROM pdaily
                     WHERE sale_date > {AS_OF} - INTERVAL 365 DAY GROUP BY store_id, barcode) r
            ON r.store_id = a.store_id AND r.barcode = a.barcode
          JOIN products pr ON pr.barcode = a.barcode
          CROSS JOIN (SELECT CAST(range AS INT) AS day_no FROM range(-1, 9)) d) g) t) u""",
        ("pdaily", "products"),
    ),
    "pdaily": (
        f"""SELECT store_id, barcode, sale_date, SUM(amount) AS daily_total FROM sales WHERE sale_date <= {AS_OF}
GROUP BY store_id, barcode, sale_date""",
        ("sales",),
    ),
    "scans_raw": (
        """SELECT event_id AS id, CAST(user_id + 1 AS INT) AS store_id,
  CASE event_id % 10 WHEN 0 THEN '   ' WHEN 1 THEN concat('  ', concat('Brand#', CAST(event_id % 25 + 1 AS VARCHAR)), ' ')
    ELSE concat('Brand#', CAST(event_id % 25 + 1 AS VARCHAR)) END AS barcode,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, 1 AS amount
FROM events""",
        (),
    ),
    "key_events": (
        """SELECT user_id AS device, event_id AS seq, ts,
  CASE WHEN event_type = 'signup' THEN 'ENTER' WHEN event_type = 'error' THEN NULL ELSE upper(substr(event_type, 1, 1)) END AS key
FROM events""",
        (),
    ),
    "all_key_events": (
        """SELECT device, seq, ts, key FROM key_events
UNION ALL SELECT -device - 1, seq, CASE WHEN seq % 5 = 0 THEN ts + INTERVAL 75 YEAR ELSE ts END, key FROM key_events WHERE device % 5 = 0 AND seq % 7 <> 0""",
        ("key_events",),
    ),
    "registrations": (
        """SELECT c_custkey AS request_id,
  CASE WHEN c_custkey % 13 = 0 THEN 'Al' WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN 'a@b'
    WHEN c_custkey % 11 = 0 THEN concat(' store', CAST(c_custkey % 50 + 1 AS VARCHAR), '@example.com ')
    ELSE concat(lower(c_mktsegment), '@example.com') END AS email,
  concat('CITY_', CAST(c_nationkey AS VARCHAR)) AS city, c_acctbal AS lat, c_acctbal AS lng
FROM customer""",
        (),
    ),
    "catalog": (
        "SELECT barcode, product_name AS name, category, image_url FROM products WHERE brand_no % 5 = 0 AND brand_no % 2 = 1",
        ("products",),
    ),
    "known_products": (
        "SELECT barcode, product_name, category, image_url FROM products WHERE brand_no % 5 <> 0",
        ("products",),
    ),
    "registry_state": (
        "SELECT barcode, CAST(brand_no * 3 AS BIGINT) AS total_examples FROM products",
        ("products",),
    ),
    "registry_before": (
        """SELECT barcode, CAST(brand_no * 3 AS BIGINT) AS total_examples FROM products WHERE brand_no > 3
UNION ALL SELECT concat(barcode, '-old'), CAST(brand_no AS BIGINT) FROM products WHERE brand_no % 3 = 0""",
        ("products",),
    ),
    "hourly_weather": (
        """SELECT store_id, sale_date AS date,
  list_transform(range(24), lambda h: 10.0 + CAST(h AS DOUBLE) / 2.0 + CAST(store_id AS DOUBLE)) AS temperature_2m,
  list_transform(range(24), lambda h: CASE (store_id + h) % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 61 ELSE 95 END) AS weather_code
FROM (SELECT DISTINCT store_id, sale_date FROM sales) k WHERE (store_id + day(sale_date)) % 9 <> 0""",
        ("sales",),
    ),
    "package_queue": (
        """SELECT CAST(user_id + 1 AS INT) AS client_id, event_id AS seq,
  CASE WHEN event_id % 17 = 0 THEN '  ' ELSE concat(CAST(user_id + 1 AS VARCHAR), '_', strftime(ts, '%d-%m-%Y_%H-%M-%S'), '.json') END AS package_name,
  CASE WHEN event_type = 'error' THEN 'network_error' WHEN value >= 45.0 THEN 'rejected' ELSE 'ok' END AS outcome
FROM events""",
        (),
    ),
}


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(names, body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <views in dependency order>, <extra CTEs> <body>``."""
    parts = [f"{n} AS ({VIEWS[n][0]})" for n in _closure(names)]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
