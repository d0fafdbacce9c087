"""Oracle SQL (DuckDB) for every key of ``__spark_entry__.queries()``."""

from __future__ import annotations

from sqlcheck.views import AS_OF, EVENTS_AS_OF, with_views

# B1 internal weather code as SQL text over a column expression.
def wcode(c: str) -> str:
    return (
        f"CASE WHEN {c} = 0 THEN 0 WHEN {c} IN (1, 2) THEN 1 WHEN {c} = 3 THEN 2 WHEN {c} BETWEEN 51 AND 67 THEN 3 "
        f"WHEN {c} BETWEEN 80 AND 82 THEN 4 WHEN {c} BETWEEN 95 AND 99 THEN 5 ELSE 1 END"
    )


DAILY = f"""SELECT g.store_id, g.barcode, g.sale_date, g.amount, g.temperature, f.weather_code
FROM (SELECT store_id, barcode, sale_date, CAST(SUM(amount) AS BIGINT) AS amount, AVG(temperature) AS temperature
      FROM sales GROUP BY 1, 2, 3) g
JOIN (SELECT store_id, barcode, sale_date, wc AS weather_code,
             ROW_NUMBER() OVER (PARTITION BY store_id, barcode, sale_date ORDER BY COUNT(*) DESC, wc) AS rn
      FROM (SELECT *, {wcode('weather_resume_wmo_code')} AS wc FROM sales) s GROUP BY store_id, barcode, sale_date, wc) f
  ON f.store_id = g.store_id AND f.barcode = g.barcode AND f.sale_date = g.sale_date AND f.rn = 1"""

HIST = f"""SELECT store_id, barcode, AVG(CAST(daily_total AS DOUBLE)) AS v_p, COUNT(*) AS n_days
FROM (SELECT store_id, barcode, sale_date, SUM(amount) AS daily_total FROM sales
      WHERE sale_date >= {AS_OF} - 30 AND sale_date <= {AS_OF} GROUP BY 1, 2, 3) t
GROUP BY store_id, barcode"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["daily_sales"] = with_views(
        ["sales"],
        "SELECT store_id, barcode, sale_date, amount, (floor((temperature) * 1e6 + 0.5) / 1e6) AS temperature, weather_code FROM daily",
        {"daily": DAILY},
    )
    q["historical_average"] = with_views(
        ["sales"], "SELECT store_id, barcode, (floor((v_p) * 1e6 + 0.5) / 1e6) AS v_p, n_days FROM hist", {"hist": HIST}
    )
    q["rolling_average"] = q["historical_average"]
    build_more(q)
    build_models(q)
    build_dash(q)
    build_docs(q)
    return q


UPCOMING = f"""SELECT store_id, barcode, COALESCE(product_name, 'Producto Desconocido') AS product_name,
  COALESCE(category, 'Sin categoría') AS category, objective_date, prediction, COALESCE(feature, false) AS feature, type,
  COALESCE(percentage_average_deviation, 0.0) AS percentage_average_deviation
FROM predictions WHERE objective_date BETWEEN {AS_OF} AND {AS_OF} + 7"""

WORST = """SELECT * EXCLUDE (rn), CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY abs(percentage_average_deviation) DESC, feature DESC,
  objective_date, barcode) AS INTEGER) AS summary_rank
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, barcode ORDER BY abs(percentage_average_deviation) DESC, feature DESC, objective_date) AS rn
      FROM upcoming) t WHERE rn = 1"""

TOP = """SELECT * FROM (SELECT * EXCLUDE (rn), CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY abs(percentage_average_deviation) DESC,
  objective_date, barcode) AS INTEGER) AS alert_rank
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, barcode ORDER BY abs(percentage_average_deviation) DESC, objective_date) AS rn
      FROM upcoming WHERE feature) t WHERE rn = 1) u WHERE alert_rank <= 10"""

STATS = """SELECT a.*, b.deficit_products, b.superavit_products, b.neutral_products FROM
 (SELECT store_id, COUNT(*) AS total_prediction_rows, COUNT(*) FILTER (WHERE type = 'deficit') AS deficit_rows, COUNT(*) FILTER (WHERE type = 'superavit') AS superavit_rows,
   COUNT(*) FILTER (WHERE type = 'none') AS neutral_rows, COUNT(*) FILTER (WHERE feature) AS featured_rows, COUNT(DISTINCT barcode) AS unique_products,
   COUNT(DISTINCT CASE WHEN feature THEN barcode END) AS unique_featured_products,
   MIN(objective_date) AS date_range_start, MAX(objective_date) AS date_range_end
  FROM upcoming GROUP BY store_id) a
 JOIN (SELECT store_id, COUNT(*) FILTER (WHERE type = 'deficit') AS deficit_products, COUNT(*) FILTER (WHERE type = 'superavit') AS superavit_products,
   COUNT(*) FILTER (WHERE type = 'none') AS neutral_products FROM worst GROUP BY store_id) b ON a.store_id = b.store_id"""

CATB = """SELECT store_id, category, total_products, deficit_count, superavit_count, neutral_count, featured_count,
  CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY total_products DESC, category) AS INTEGER) AS category_rank
FROM (SELECT store_id, category, COUNT(*) AS total_products, COUNT(*) FILTER (WHERE type = 'deficit') AS deficit_count,
   COUNT(*) FILTER (WHERE type = 'superavit') AS superavit_count, COUNT(*) FILTER (WHERE type IS NULL OR type NOT IN ('deficit', 'superavit')) AS neutral_count,
   COUNT(*) FILTER (WHERE feature) AS featured_count FROM worst GROUP BY store_id, category) t"""

ACTIVE = """SELECT store_id, owner_name, regexp_replace(email, '^\\s+|\\s+$', '', 'g') AS email, city FROM stores
WHERE email IS NOT NULL AND trim(email) <> '' AND email LIKE '%@%'"""

EMAIL_RE = "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$"


def dev_out(c: str = "percentage_average_deviation") -> str:
    return f"CASE WHEN isinf({c}) THEN NULL ELSE (floor(({c}) * 1e6 + 0.5) / 1e6) END AS {c}, COALESCE(isinf({c}), false) AS is_atypical"


ROWCOLS = "store_id, barcode, product_name, category, objective_date, prediction, feature, type"

FEATS = """(floor((sin(2 * pi() * (isodow(sale_date) - 1) / 7.0)) * 1e6 + 0.5) / 1e6) AS sin_weekday,
  (floor((cos(2 * pi() * (isodow(sale_date) - 1) / 7.0)) * 1e6 + 0.5) / 1e6) AS cos_weekday,
  (floor((sin(2 * pi() * day(sale_date) / 31.0)) * 1e6 + 0.5) / 1e6) AS sin_day, (floor((cos(2 * pi() * day(sale_date) / 31.0)) * 1e6 + 0.5) / 1e6) AS cos_day,
  (floor((sin(2 * pi() * month(sale_date) / 12.0)) * 1e6 + 0.5) / 1e6) AS sin_month, (floor((cos(2 * pi() * month(sale_date) / 12.0)) * 1e6 + 0.5) / 1e6) AS cos_month"""

PAYDAY = "CASE WHEN day(sale_date) BETWEEN 13 AND 17 OR day(sale_date) >= 27 THEN 1 ELSE 0 END"

FILLED = """SELECT store_id, barcode, sale_date, amount, COALESCE(temperature, AVG(temperature) OVER (PARTITION BY barcode), 22.0) AS temperature,
  weather_code FROM daily"""

WEEKDAYS = "['Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo']"
MONTHS = "['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre', 'Octubre', 'Noviembre', 'Diciembre']"

HALF = """SELECT store_id, TRY_CAST(CASE WHEN length(trim(time)) > 8 THEN substr(trim(time), 1, 10) END AS DATE) AS sale_date,
  printf('%02d:%02d:00', CAST(substr(trim(time), -8, 2) AS INT), CASE WHEN CAST(substr(trim(time), -5, 2) AS INT) < 30 THEN 0 ELSE 30 END) AS block,
  barcode, CAST(SUM(amount) AS BIGINT) AS amount
FROM scans GROUP BY 1, 2, 3, 4"""

SCANS = """SELECT id, store_id, regexp_replace(barcode, '^\\s+|\\s+$', '', 'g') AS barcode, time, 1 AS amount FROM scans_raw
WHERE length(regexp_replace(barcode, '^\\s+|\\s+$', '', 'g')) > 0"""

PACKAGES = """SELECT store_id AS id_store, strftime(sale_date, '%d-%m-%Y') AS date, CAST(isodow(sale_date) AS INTEGER) AS day, CAST(COUNT(DISTINCT block) AS INTEGER) AS blocks,
  sale_date FROM half GROUP BY store_id, sale_date"""


def build_more(q: dict[str, str]) -> None:
    s = ["sales"]
    q["sales_scan"] = with_views(
        s, "SELECT store_id, barcode, sale_date, amount, temperature, weather_resume_wmo_code FROM sales"
    )
    q["recent_sales"] = with_views(
        s,
        f"SELECT store_id, barcode, sale_date, amount, temperature, weather_resume_wmo_code FROM sales "
        f"WHERE sale_date >= {AS_OF} - 2 AND sale_date <= {AS_OF}",
    )
    q["examples_per_product"] = with_views(s, "SELECT barcode, COUNT(*) AS n_examples FROM sales GROUP BY barcode")
    q["sold_products"] = with_views(s, "SELECT DISTINCT barcode FROM sales WHERE barcode IS NOT NULL")
    q["sales_history"] = with_views(
        s,
        "SELECT store_id, barcode, strftime(sale_date, '%Y-%m-%d') AS date, CAST(SUM(amount) AS BIGINT) AS volume "
        "FROM sales GROUP BY store_id, barcode, sale_date",
    )
    q["store_list"] = with_views(["stores"], "SELECT store_id, latitude, longitude FROM stores")
    q["product_lookup"] = with_views(
        ["sales", "products"],
        "SELECT barcode, product_name, category, image_url FROM products WHERE barcode IN (SELECT barcode FROM sales)",
    )
    q["daily_sales_filled"] = with_views(
        s, "SELECT store_id, barcode, sale_date, amount, (floor((temperature) * 1e6 + 0.5) / 1e6) AS temperature, weather_code FROM filled",
        {"daily": DAILY, "filled": FILLED},
    )
    q["feature_matrix"] = with_views(
        s,
        f"""SELECT store_id, barcode, sale_date, {FEATS}, CAST({PAYDAY} AS DOUBLE) AS payday,
  (floor((CASE WHEN temperature IS NULL OR temperature = 0 THEN 20.0 ELSE temperature END) * 1e6 + 0.5) / 1e6) AS temperature,
  CAST(CASE WHEN weather_code IS NULL OR weather_code = 0 THEN 1 ELSE weather_code END AS DOUBLE) AS weather_code,
  CAST(store_id AS DOUBLE) AS store_f, CAST(amount AS DOUBLE) AS y FROM filled""",
        {"daily": DAILY, "filled": FILLED},
    )
    q["weather_code"] = with_views(
        s,
        f"SELECT weather_resume_wmo_code AS wmo, {wcode('weather_resume_wmo_code')} AS weather_code, COUNT(*) AS n_rows "
        "FROM sales GROUP BY 1, 2",
    )
    q["cyclic_features"] = with_views(
        s,
        f"SELECT sale_date, {FEATS}, {PAYDAY} AS payday, CAST(isodow(sale_date) AS INTEGER) AS iso_weekday FROM (SELECT DISTINCT sale_date FROM sales) d",
    )
    q["clamp_round"] = (
        "SELECT l_orderkey, l_linenumber, l_quantity / 2.0 - 5.0 AS raw, "
        "CAST((round_even(greatest(l_quantity / 2.0 - 5.0, 0.0), 0) + 0.0) AS INT) AS prediction FROM lineitem"
    )
    q["classify_alerts"] = with_views(
        ["predictions", "sales"],
        f"""SELECT store_id, barcode, objective_date, prediction, type, type <> 'none' AS feature, {dev_out()} FROM (
  SELECT *, CASE WHEN percentage_average_deviation <= -15.0 THEN 'deficit' WHEN percentage_average_deviation >= 15.0 THEN 'superavit'
    ELSE 'none' END AS type FROM (
    SELECT p.store_id, p.barcode, p.objective_date, p.prediction,
      CASE WHEN COALESCE(h.v_p, 0.0) > 0 THEN (CAST(p.prediction AS DOUBLE) - h.v_p) / h.v_p * 100.0
           WHEN p.prediction > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0.0 END AS percentage_average_deviation
    FROM predictions p LEFT JOIN hist h ON h.store_id = p.store_id AND h.barcode = p.barcode) a) b""",
        {"hist": HIST},
    )
    q["alert_labels"] = with_views(
        ["predictions"],
        f"""SELECT store_id, barcode, objective_date, type,
  CASE type WHEN 'deficit' THEN 'Déficit' WHEN 'superavit' THEN 'Superávit' ELSE 'Estable' END AS label_report,
  CASE type WHEN 'deficit' THEN 'DÉFICIT' WHEN 'superavit' THEN 'SUPERÁVIT' ELSE 'NORMAL' END AS label_mail,
  CASE type WHEN 'deficit' THEN 'DÉFICIT' WHEN 'superavit' THEN 'SUPERÁVIT' ELSE 'ESTABLE' END AS label_ui,
  CASE WHEN d > 0 THEN 'positive' WHEN d < 0 THEN 'negative' ELSE 'neutral' END AS sign_class,
  CASE WHEN NOT isinf(d) THEN concat(CASE WHEN d > 0 THEN '+' ELSE '' END, printf('%.1f', d), '%') END AS deviation_text
FROM (SELECT *, percentage_average_deviation AS d FROM upcoming) u""",
        {"upcoming": UPCOMING},
    )
    q["date_labels"] = with_views(
        s,
        f"""SELECT sale_date, sale_date AS parsed, strftime(sale_date, '%d/%m/%Y') AS label_slash, strftime(sale_date, '%Y-%m-%d') AS label_iso,
  concat(strftime(sale_date, '%d-%m-%Y'), ' al ', strftime(sale_date + 7, '%d-%m-%Y')) AS period_label,
  concat(list_extract({WEEKDAYS}, isodow(sale_date)), ', ', list_extract({MONTHS}, month(sale_date)), ' ',
         CAST(day(sale_date) AS VARCHAR), ', ', CAST(year(sale_date) AS VARCHAR)) AS long_date
FROM (SELECT DISTINCT sale_date FROM sales) d""",
    )
    # weekly report family
    rp = ["predictions"]
    q["active_stores"] = with_views(["stores"], ACTIVE)
    q["upcoming_predictions"] = with_views(rp, f"SELECT {ROWCOLS}, {dev_out()} FROM upcoming", {"upcoming": UPCOMING})
    q["worst_case_rows"] = with_views(
        rp, f"SELECT {ROWCOLS}, summary_rank, {dev_out()} FROM worst", {"upcoming": UPCOMING, "worst": WORST}
    )
    q["top_alerts"] = with_views(rp, f"SELECT {ROWCOLS}, alert_rank, {dev_out()} FROM top", {"upcoming": UPCOMING, "top": TOP})
    q["weekly_stats"] = with_views(rp, "SELECT * FROM stats", {"upcoming": UPCOMING, "worst": WORST, "stats": STATS})
    cols = ("total_prediction_rows deficit_rows superavit_rows neutral_rows featured_rows unique_products unique_featured_products "
            "deficit_products superavit_products neutral_products").split()
    q["weekly_stats_all_stores"] = with_views(
        ["stores", "predictions"],
        "SELECT s.store_id, " + ", ".join(f"COALESCE(t.{c}, 0) AS {c}" for c in cols)
        + f", COALESCE(t.date_range_start, {AS_OF}) AS date_range_start, COALESCE(t.date_range_end, CAST({AS_OF} + 7 AS DATE)) AS date_range_end,"
        " t.total_prediction_rows IS NULL AS is_empty FROM stores s LEFT JOIN stats t ON t.store_id = s.store_id",
        {"upcoming": UPCOMING, "worst": WORST, "stats": STATS},
    )
    q["category_breakdown"] = with_views(rp, "SELECT * FROM catb", {"upcoming": UPCOMING, "worst": WORST, "catb": CATB})
    pct = ", ".join(
        f"CASE WHEN total_products > 0 THEN CAST((round_even(100.0 * {k}_count / total_products, 0) + 0.0) AS INT) END AS {k}_pct, "
        f"CASE WHEN {k}_count > 0 THEN CAST({k}_count AS VARCHAR) ELSE '—' END AS {k}_text"
        for k in ("deficit", "superavit", "neutral")
    )
    q["category_proportions"] = with_views(
        rp,
        f"SELECT *, {pct}, CASE WHEN featured_count > 0 THEN CAST(featured_count AS VARCHAR) ELSE '—' END AS featured_text FROM catb",
        {"upcoming": UPCOMING, "worst": WORST, "catb": CATB},
    )
    q["run_summary"] = with_views(
        ["stores", "predictions"],
        """SELECT COUNT(*) AS active_stores, COUNT(*) FILTER (WHERE r.ok = true) AS succeeded, COUNT(*) FILTER (WHERE r.ok = false) AS failed, COUNT(*) FILTER (WHERE r.ok IS NULL) AS skipped
FROM active a LEFT JOIN (SELECT store_id, regexp_matches(email, '""" + EMAIL_RE + """') AS ok FROM active
  WHERE store_id IN (SELECT store_id FROM upcoming)) r ON r.store_id = a.store_id""",
        {"active": ACTIVE, "upcoming": UPCOMING},
    )
    # ingest family
    q["validate_registrations"] = with_views(
        ["registrations"],
        f"""SELECT *, length(regexp_replace(COALESCE(name, ''), '^\\s+|\\s+$', '', 'g')) >= 3
   AND NOT regexp_matches(COALESCE(name, ''), '[\\p{{Nd}}¹²³⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]') AS valid_name,
  regexp_matches(regexp_replace(COALESCE(email, ''), '^\\s+|\\s+$', '', 'g'), '{EMAIL_RE}') AS valid_email FROM registrations""",
    )
    q["register_stores"] = with_views(
        ["registrations", "stores"],
        """SELECT r.request_id, r.name, r.email,
  CASE WHEN NOT valid THEN 'invalid' WHEN ok THEN 'exito' ELSE 'email_repeated' END AS status,
  CASE WHEN ok THEN (SELECT MAX(store_id) FROM stores) + ROW_NUMBER() OVER (PARTITION BY ok ORDER BY r.request_id) END AS store_id
FROM (SELECT v.*, v.valid AND v.email NOT IN (SELECT email FROM stores WHERE email IS NOT NULL)
        AND v.request_id = MIN(CASE WHEN v.valid THEN v.request_id END) OVER (PARTITION BY v.email) AS ok
      FROM (SELECT *, name IS NOT NULL AND email IS NOT NULL AND city IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL AS valid
            FROM registrations) v) r""",
    )
    q["register_batches"] = with_views(
        ["registrations", "stores"],
        """SELECT r.request_id, r.name, r.email,
  CASE WHEN NOT valid THEN 'invalid' WHEN ok THEN 'exito' ELSE 'email_repeated' END AS status,
  CASE WHEN ok THEN (SELECT MAX(store_id) FROM stores) + ROW_NUMBER() OVER (PARTITION BY ok ORDER BY r.batch, r.request_id) END AS store_id
FROM (SELECT v.*, v.valid AND v.email NOT IN (SELECT email FROM stores WHERE email IS NOT NULL)
        AND v.request_id = MIN(CASE WHEN v.valid THEN v.request_id END) OVER (PARTITION BY v.email, v.batch) AS ok
      FROM (SELECT *, request_id % 2 AS batch, name IS NOT NULL AND email IS NOT NULL AND city IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL AS valid
            FROM registrations) v) r""",
    )
    q["clean_scans"] = with_views(["scans_raw"], SCANS)
    q["half_hour_sales"] = with_views(["scans_raw"], "SELECT * FROM half", {"scans": SCANS, "half": HALF})
    q["scan_totals"] = with_views(
        ["scans_raw", "stores"],
        "SELECT s.store_id, COALESCE(t.total_units, 0) AS total_units FROM stores s LEFT JOIN "
        "(SELECT store_id, CAST(SUM(amount) AS BIGINT) AS total_units FROM scans GROUP BY store_id) t ON t.store_id = s.store_id",
        {"scans": SCANS},
    )
    pk = {"scans": SCANS, "half": HALF, "packages": PACKAGES}
    q["package_receipts"] = with_views(["scans_raw"], "SELECT id_store, date, blocks FROM packages", pk)
    q["package_accept"] = with_views(
        ["scans_raw", "stores"], "SELECT id_store, date, day, blocks FROM packages WHERE id_store IN (SELECT store_id FROM stores)", pk
    )
    q["package_reject"] = with_views(
        ["scans_raw", "stores"], "SELECT id_store, date, day, blocks FROM packages WHERE id_store NOT IN (SELECT store_id FROM stores)", pk
    )
    q["ingest_accounting"] = with_views(
        ["scans_raw", "stores"],
        """SELECT outcome, CAST(SUM(n) AS BIGINT) AS documents FROM (
  SELECT CASE WHEN id_store NOT IN (SELECT store_id FROM stores) THEN 'unknown_store' WHEN id_store % 5 = 0 THEN 'duplicate' ELSE 'received' END AS outcome,
    CASE WHEN id_store IN (SELECT store_id FROM stores) AND id_store % 5 <> 0 THEN 1 WHEN id_store % 3 = 0 THEN 2 ELSE 1 END AS n FROM packages
  UNION ALL SELECT 'duplicate', 1 FROM packages WHERE id_store IN (SELECT store_id FROM stores) AND id_store % 5 <> 0 AND id_store % 3 = 0
) GROUP BY outcome""",
        pk,
    )
    q["ingest_batch"] = with_views(
        ["scans_raw", "stores"],
        """SELECT outcome, CAST(SUM(n) AS BIGINT) AS n FROM (
  SELECT unnest([{'outcome': COALESCE(problem, 'received'), 'n': CASE WHEN problem IS NOT NULL THEN copies WHEN id_store % 5 = 0 THEN 0 ELSE 1 END},
    {'outcome': 'duplicate', 'n': CASE WHEN problem IS NOT NULL THEN 0 WHEN id_store % 5 = 0 THEN copies ELSE copies - 1 END},
    {'outcome': 'units', 'n': CASE WHEN problem IS NULL AND id_store % 5 <> 0 THEN units ELSE 0 END}], recursive := true)
  FROM (SELECT p.id_store, CASE WHEN (p.id_store + p.day) % 11 = 0 THEN 'bad_date' WHEN (p.id_store + p.day) % 11 = 1 THEN 'bad_time'
      WHEN p.id_store NOT IN (SELECT store_id FROM stores) THEN 'unknown_store' END AS problem, CASE WHEN p.id_store % 3 = 0 THEN 2 ELSE 1 END AS copies,
      (SELECT SUM(amount) FROM half h WHERE h.store_id = p.id_store AND h.sale_date = p.sale_date) AS units FROM packages p)
) GROUP BY outcome HAVING SUM(n) > 0""",
        pk,
    )
    q["retention_elapsed"] = f"SELECT event_id AS backup, ts AS modified FROM events WHERE epoch_us({EVENTS_AS_OF} + INTERVAL 12 HOUR) - epoch_us(ts) <= 30 * 86400000000"
    q["package_round_trip"] = with_views(
        ["scans_raw"], "SELECT store_id, sale_date, block AS time, CAST(substr(block, 1, 2) AS INT) AS hour, barcode, CAST(amount AS INT) AS amount FROM half", pk
    )
    q["retry_rejected"] = with_views(
        ["scans_raw", "stores"], "SELECT id_store, date, day, blocks FROM packages WHERE id_store NOT IN (SELECT store_id FROM stores) AND id_store % 2 = 0", pk
    )
    q["queue_passes"] = with_views(
        ["package_queue"],
        """SELECT client_id, seq, trim(package_name) AS package_name, CAST(outcome = 'rejected' OR seq >= fail AS INTEGER) AS tries
FROM (SELECT *, COALESCE(MIN(CASE WHEN outcome = 'network_error' THEN seq END) OVER (PARTITION BY client_id), 9223372036854775807) AS fail
  FROM package_queue WHERE length(trim(package_name)) > 0)""",
    )
    q["half_hour_totals"] = with_views(["scans_raw"], "SELECT * FROM half", {"scans": SCANS, "half": HALF})
    q["half_hour_windows"] = with_views(["scans_raw"], "SELECT * FROM half WHERE sale_date IS NOT NULL", {"scans": SCANS, "half": HALF})
    q["forecast_pairs"] = with_views(
        ["forecast_payloads"],
        "SELECT store_id, CAST(i - 1 AS INT) AS day_no, temperature_2m_max[i] AS high, temperature_2m_min[i] AS low "
        "FROM (SELECT *, unnest(range(1, least(len(temperature_2m_max), len(temperature_2m_min)) + 1)) AS i FROM forecast_payloads)",
    )
    q["retention_filter"] = with_views(
        ["scans_raw"], f"SELECT id_store, date FROM packages WHERE date_diff('day', sale_date, {EVENTS_AS_OF}) <= 30", pk
    )
    q["sales_with_weather"] = with_views(
        ["sales", "hourly_weather"],
        """SELECT s.store_id, s.barcode, s.sale_date, s.time, s.amount, h.temperature, h.wmo AS weather_resume_wmo_code
FROM sales s LEFT JOIN (SELECT store_id, date, unnest(range(24)) AS hour, unnest(temperature_2m) AS temperature, unnest(weather_code) AS wmo
  FROM hourly_weather) h ON h.store_id = s.store_id AND h.date = s.sale_date AND h.hour = CAST(substr(s.time, 1, 2) AS INT)""",
    )
    q["hourly_weather_rows"] = with_views(
        ["sales", "hourly_weather"],
        """SELECT store_id, date, CAST(unnest(range(24)) AS INT) AS hour, unnest(temperature_2m) AS temperature,
  unnest(weather_code) AS weather_resume_wmo_code FROM hourly_weather""",
    )
    q["complete_products"] = with_views(
        ["sales", "known_products", "catalog"],
        """SELECT m.barcode, CASE WHEN c.barcode IS NOT NULL THEN COALESCE(c.name, 'Nombre no disponible') ELSE 'Producto Desconocido' END AS product_name,
  COALESCE(c.category, 'Sin Categoría') AS category, COALESCE(c.image_url, 'Sin Imagen') AS image_url
FROM (SELECT DISTINCT barcode FROM sales WHERE barcode NOT IN (SELECT barcode FROM known_products)) m
LEFT JOIN catalog c ON c.barcode = m.barcode""",
    )
    q["pending_packages"] = with_views(
        ["package_queue"],
        """SELECT q.client_id, q.seq, trim(q.package_name) AS package_name FROM package_queue q
LEFT JOIN (SELECT client_id, MIN(seq) AS f FROM package_queue WHERE length(trim(package_name)) > 0 AND outcome = 'network_error'
           GROUP BY client_id) x ON x.client_id = q.client_id
WHERE length(trim(q.package_name)) > 0 AND (q.outcome = 'rejected' OR q.seq >= x.f)""",
    )


def daily_of(src: str) -> str:
    return DAILY.replace("FROM sales", f"FROM {src}")


FEATURES = ["sin_weekday", "cos_weekday", "sin_day", "cos_day", "sin_month", "cos_month", "payday", "temperature", "weather_code", "store_f"]


def feats_raw(d: str) -> str:
    return f"""sin(2 * pi() * (isodow({d}) - 1) / 7.0) AS sin_weekday, cos(2 * pi() * (isodow({d}) - 1) / 7.0) AS cos_weekday,
  sin(2 * pi() * day({d}) / 31.0) AS sin_day, cos(2 * pi() * day({d}) / 31.0) AS cos_day,
  sin(2 * pi() * month({d}) / 12.0) AS sin_month, cos(2 * pi() * month({d}) / 12.0) AS cos_month,
  CAST(CASE WHEN day({d}) BETWEEN 13 AND 17 OR day({d}) >= 27 THEN 1 ELSE 0 END AS DOUBLE) AS payday"""


FLAGS = f"""SELECT d.barcode, CAST(COALESCE(r.total_examples, 0) AS BIGINT) AS prev_examples, COALESCE(r.total_examples, 0) < 30 AS is_cold
FROM (SELECT DISTINCT barcode FROM sales WHERE sale_date <= {AS_OF}) d LEFT JOIN registry_state r ON r.barcode = d.barcode"""

TSALES = f"""SELECT s.* FROM sales s JOIN flags f ON f.barcode = s.barcode
WHERE s.sale_date <= {AS_OF} AND (f.is_cold OR s.sale_date >= {AS_OF} - 2)"""

TROWS = f"""SELECT t.store_id, t.barcode, t.sale_date, {feats_raw('t.sale_date')},
  CASE WHEN t.temperature IS NULL OR t.temperature = 0 THEN 20.0 ELSE t.temperature END AS temperature,
  CAST(CASE WHEN t.weather_code IS NULL OR t.weather_code = 0 THEN 1 ELSE t.weather_code END AS DOUBLE) AS weather_code,
  CAST(t.store_id AS DOUBLE) AS store_f, CAST(t.amount AS DOUBLE) AS y, f.prev_examples, f.is_cold
FROM tfilled t JOIN flags f ON f.barcode = t.barcode"""

FIXED_COEF = [5.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.08, 0.09, 0.01]


def fixed_dot(prefix: str = "") -> str:
    acc = "CAST(0.0 AS DOUBLE)"
    for w, f in zip(FIXED_COEF[1:], FEATURES):
        acc = f"({acc} + CAST({w!r} AS DOUBLE) * {prefix}{f})"
    return f"(CAST({FIXED_COEF[0]!r} AS DOUBLE) + {acc})"


FC = f"""SELECT store_id, CAST(start_date + CAST(i AS INT) AS DATE) AS objective_date, (tmax + tmin) / 2.0 AS temperature,
  {wcode('wc')} AS weather_code
FROM (SELECT store_id, start_date, unnest(range(len(weather_code))) AS i, unnest(temperature_2m_max) AS tmax,
        unnest(temperature_2m_min) AS tmin, unnest(weather_code) AS wc FROM forecast_payloads) z WHERE i < 7"""

DAYS = f"""SELECT s.store_id, CAST({AS_OF} + CAST(d.i AS INT) AS DATE) AS objective_date, COALESCE(f.temperature, 22.0) AS temperature,
  COALESCE(f.weather_code, 1) AS weather_code, f.temperature IS NULL AS is_fallback
FROM stores s CROSS JOIN (SELECT range AS i FROM range(7)) d
LEFT JOIN fc f ON f.store_id = s.store_id AND f.objective_date = CAST({AS_OF} + CAST(d.i AS INT) AS DATE)"""

GRID = f"""SELECT a.store_id, a.barcode, d.objective_date, d.temperature, d.weather_code, p.product_name, p.category, p.image_url
FROM (SELECT DISTINCT store_id, barcode FROM sales WHERE sale_date <= {AS_OF}) a
JOIN days d ON d.store_id = a.store_id JOIN products p ON p.barcode = a.barcode"""

SCOREF = f"""SELECT store_id, barcode, product_name, category, image_url, objective_date, prediction, type <> 'none' AS feature, type,
  percentage_average_deviation FROM (
 SELECT *, CASE WHEN percentage_average_deviation <= -15.0 THEN 'deficit' WHEN percentage_average_deviation >= 15.0 THEN 'superavit'
   ELSE 'none' END AS type FROM (
  SELECT *, CASE WHEN v_p > 0 THEN (CAST(prediction AS DOUBLE) - v_p) / v_p * 100.0 WHEN prediction > 0 THEN CAST('Infinity' AS DOUBLE)
    ELSE 0.0 END AS percentage_average_deviation FROM (
   SELECT *, CAST((round_even(greatest({fixed_dot()}, 0.0), 0) + 0.0) AS INT) AS prediction FROM (
    SELECT g.store_id, g.barcode, g.product_name, g.category, g.image_url, g.objective_date, COALESCE(h.v_p, 0.0) AS v_p,
      {feats_raw('g.objective_date')}, CAST(g.temperature AS DOUBLE) AS temperature, CAST(g.weather_code AS DOUBLE) AS weather_code,
      CAST(g.store_id AS DOUBLE) AS store_f
    FROM grid g JOIN registry_state r ON r.barcode = g.barcode AND r.total_examples >= 30
    LEFT JOIN hist h ON h.store_id = g.store_id AND h.barcode = g.barcode) a) b) c) e"""


def build_models(q: dict[str, str]) -> None:
    tv = ["sales", "registry_state"]
    tx = {"flags": FLAGS, "tsales": TSALES, "tdaily": daily_of("tsales"),
          "tfilled": FILLED.replace("FROM daily", "FROM tdaily"), "trows": TROWS}
    feats_r6 = ", ".join(f"(floor(({f}) * 1e6 + 0.5) / 1e6) AS {f}" for f in FEATURES)
    q["training_rows"] = with_views(tv, f"SELECT store_id, barcode, sale_date, {feats_r6}, y, prev_examples, is_cold FROM trows", tx)
    var = [*FEATURES, "y"]
    numbers = ["1.0", *[f"AVG({v})" for v in var]] + [f"covar_pop({var[i]}, {var[j]})" for i in range(11) for j in range(i, 11)]
    q["training_moments"] = with_views(
        tv,
        f"""SELECT barcode, n, CAST(k AS INTEGER) AS k, (floor(v * 1e6 + 0.5) / 1e6) AS mean_value FROM (
  SELECT barcode, n, unnest(range(78)) AS k, unnest(m) AS v FROM (
    SELECT barcode, COUNT(*) AS n, [{', '.join(numbers)}] AS m FROM trows GROUP BY barcode) a) b""",
        tx,
    )
    q["training_outcomes"] = with_views(
        tv,
        f"""SELECT f.barcode, CASE WHEN r.n IS NULL THEN 'skipped' WHEN f.is_cold THEN 'cold' ELSE 'incremental' END AS outcome,
  CAST(COALESCE(r.n, 0) AS BIGINT) AS n
FROM flags f LEFT JOIN (SELECT barcode, COUNT(*) AS n FROM trows GROUP BY barcode) r ON r.barcode = f.barcode""",
        tx,
    )
    q["train_incremental_counts"] = with_views(
        ["sales"],
        f"""SELECT barcode,
  CAST(n_old + n_new AS BIGINT) AS n,
  CAST(CASE WHEN n_old >= 30 THEN n_new ELSE n_old + n_new END AS BIGINT) AS new_examples,
  CAST(CASE WHEN n_old >= 30 THEN n_old + n_new ELSE n_old + n_old + n_new END AS BIGINT) AS total_examples,
  {AS_OF} AS last_date
FROM (SELECT barcode, COUNT(*) FILTER (WHERE sale_date <= {AS_OF} - 7) AS n_old,
             COUNT(*) FILTER (WHERE sale_date > {AS_OF} - 7) AS n_new
      FROM (SELECT DISTINCT store_id, barcode, sale_date FROM sales WHERE sale_date <= {AS_OF}) d GROUP BY barcode) t""",
    )
    q["train_incremental_optimality"] = with_views(
        ["sales"],
        f"""SELECT barcode, COUNT(*) AS n, true AS is_optimal FROM (SELECT DISTINCT store_id, barcode, sale_date FROM sales WHERE sale_date <= {AS_OF}) d GROUP BY barcode""",
    )
    # The two-day job: day 1 (as_of - 1) replaces the stored predictions of every
    # scored pair, day 2 (as_of) replaces day 1's result again.
    def new_rows(day: str) -> str:
        return f"""SELECT a.store_id, a.barcode, p.product_name, p.category, CAST({day} + CAST(d.i AS INT) AS DATE) AS objective_date
FROM (SELECT DISTINCT store_id, barcode FROM sales WHERE sale_date <= {day}) a
JOIN products p ON p.barcode = a.barcode
JOIN (SELECT s.barcode FROM (SELECT barcode, COUNT(*) AS n FROM (SELECT DISTINCT store_id, barcode, sale_date FROM sales
      WHERE sale_date <= {day}) x GROUP BY barcode) s JOIN registry_state r ON r.barcode = s.barcode
      WHERE r.total_examples + s.n >= 30) ok ON ok.barcode = a.barcode
CROSS JOIN (SELECT range AS i FROM range(7)) d"""

    q["score_predictions_keys"] = with_views(
        ["sales", "products", "registry_state", "predictions"],
        """SELECT store_id, barcode, objective_date, product_name, category FROM (
  SELECT store_id, barcode, objective_date, product_name, category FROM after1 o
  WHERE NOT EXISTS (SELECT 1 FROM day2 n WHERE n.store_id = o.store_id AND n.barcode = o.barcode)
  UNION ALL SELECT store_id, barcode, objective_date, product_name, category FROM day2) t""",
        {
            "day1": new_rows(f"({AS_OF} - 1)"),
            "day2": new_rows(AS_OF),
            "after1": """SELECT store_id, barcode, objective_date, product_name, category FROM predictions o
  WHERE NOT EXISTS (SELECT 1 FROM day1 n WHERE n.store_id = o.store_id AND n.barcode = o.barcode)
  UNION ALL SELECT store_id, barcode, objective_date, product_name, category FROM day1""",
        },
    )
    q["clipped_mse"] = with_views(
        tv,
        f"""SELECT barcode, (floor((AVG((y - greatest(yhat, 0.0)) * (y - greatest(yhat, 0.0)))) * 1e6 + 0.5) / 1e6) AS mse, COUNT(*) AS n
FROM (SELECT *, {fixed_dot()} AS yhat FROM trows) t GROUP BY barcode""",
        tx,
    )
    q["model_optimality"] = with_views(tv, "SELECT barcode, COUNT(*) AS n, true AS is_optimal FROM trows GROUP BY barcode", tx)
    q["model_registry_upsert"] = with_views(
        [*tv, "registry_before"],
        f"""SELECT COALESCE(r.barcode, t.barcode) AS barcode, CASE WHEN t.barcode IS NOT NULL THEN (floor((t.mse) * 1e6 + 0.5) / 1e6) END AS last_mse,
  CASE WHEN t.barcode IS NOT NULL THEN CAST({AS_OF} AS TIMESTAMP) END AS last_update,
  CAST(COALESCE(r.total_examples, 0) + COALESCE(t.n, 0) AS BIGINT) AS total_examples, 'ridge_centred' AS type_model
FROM registry_before r
FULL OUTER JOIN (SELECT barcode, AVG((y - greatest(yhat, 0.0)) * (y - greatest(yhat, 0.0))) AS mse, COUNT(*) AS n
  FROM (SELECT *, {fixed_dot()} AS yhat FROM trows) t GROUP BY barcode) t
ON t.barcode = r.barcode""",
        tx,
    )
    fv = ["forecast_payloads", "stores"]
    q["forecast_days"] = with_views(fv, "SELECT * FROM fc", {"fc": FC})
    q["forecast_fallback"] = with_views(fv, "SELECT * FROM days", {"fc": FC, "days": DAYS})
    gv = ["forecast_payloads", "stores", "sales", "products"]
    gx = {"fc": FC, "days": DAYS, "grid": GRID}
    q["scoring_grid"] = with_views(
        gv, "SELECT store_id, barcode, objective_date, temperature, weather_code, product_name, category FROM grid", gx
    )
    sx = dict(gx, hist=HIST, scoref=SCOREF)
    sv = gv + ["registry_state"]
    q["score_fixed"] = with_views(sv, f"SELECT {ROWCOLS}, {dev_out()} FROM scoref", sx)
    q["predictions_per_store"] = with_views(sv, "SELECT store_id, COUNT(*) AS n_predictions FROM scoref GROUP BY store_id", sx)
    q["prediction_replace"] = with_views(
        sv + ["predictions"],
        f"""SELECT {ROWCOLS}, {dev_out()} FROM (
  SELECT * FROM predictions o WHERE NOT EXISTS (SELECT 1 FROM scoref n WHERE n.store_id = o.store_id AND n.barcode = o.barcode)
  UNION ALL SELECT * FROM scoref) u""",
        sx,
    )
    q["prediction_replace_on_disk"] = q["prediction_replace"]


ALERTS = f"""SELECT p.*, COALESCE(h.v_p * 7.0, 0.0) AS avg_weekly_sales FROM predictions p
LEFT JOIN hist h ON h.store_id = p.store_id AND h.barcode = p.barcode WHERE p.objective_date > {AS_OF}"""


SIGNED = ("concat(CASE WHEN {d} > 0 THEN '+' ELSE '' END, CASE WHEN isinf({d}) THEN 'inf' ELSE printf('%.1f', {d}) END, '%')")

LABEL = "CASE {t} WHEN 'deficit' THEN 'Déficit' WHEN 'superavit' THEN 'Superávit' ELSE 'Estable' END"

DOCS = """SELECT a.store_id, a.owner_name, a.email, s.* EXCLUDE (store_id) FROM active a JOIN stats s ON s.store_id = a.store_id"""

DIGEST_FOOTER = "El reporte completo se encuentra adjunto en formato PDF.\n\n──────────────────────────────────────────────\nEste correo fue generado automáticamente. Por favor no responda."


def build_docs(q: dict[str, str]) -> None:
    rx = {"active": ACTIVE, "upcoming": UPCOMING, "worst": WORST, "top": TOP, "stats": STATS, "docs": DOCS}
    rv = ["stores", "predictions"]
    q["report_document_rows"] = with_views(
        rv,
        f"""SELECT d.store_id, 'summary' AS section, CAST(w.summary_rank - 1 AS INT) AS pos, CAST(w.summary_rank AS INT) AS rank, w.barcode,
  strftime(w.objective_date, '%d/%m/%Y') AS date, {LABEL.format(t='w.type')} AS label,
  {SIGNED.format(d='w.percentage_average_deviation')} AS deviation_text
FROM docs d JOIN worst w ON w.store_id = d.store_id
UNION ALL
SELECT d.store_id, 'alerts' AS section, CAST(t.alert_rank - 1 AS INT) AS pos, CAST(t.alert_rank AS INT) AS rank, t.barcode,
  strftime(t.objective_date, '%d/%m/%Y') AS date, {LABEL.format(t='t.type')} AS label,
  {SIGNED.format(d='t.percentage_average_deviation')} AS deviation_text
FROM docs d JOIN top t ON t.store_id = d.store_id""",
        rx,
    )
    q["report_document_categories"] = with_views(
        rv,
        """SELECT d.store_id, CAST(c.category_rank - 1 AS INT) AS pos, c.category_rank AS rank, c.category, c.total_products, c.deficit_count, c.superavit_count, c.neutral_count, c.featured_count,
  CAST((round_even(100.0 * c.deficit_count / c.total_products, 0) + 0.0) AS INT) AS deficit_pct, CAST((round_even(100.0 * c.superavit_count / c.total_products, 0) + 0.0) AS INT) AS superavit_pct,
  CAST((round_even(100.0 * c.neutral_count / c.total_products, 0) + 0.0) AS INT) AS neutral_pct
FROM docs d JOIN catb c ON c.store_id = d.store_id""",
        rx | {"catb": CATB},
    )
    item = ("concat('  ', CAST(t.alert_rank AS VARCHAR), '. ', t.product_name, ' [', upper(t.type), '] Desv: ', "
            + SIGNED.format(d="t.percentage_average_deviation") + ", ' — Pred: ', CAST(t.prediction AS VARCHAR), ' unid.')")
    q["report_digest"] = with_views(
        rv,
        f"""SELECT d.store_id, d.email,
  concat('📊 Reporte Semanal Retail Analytics — ', d.owner_name, ' (', strftime(d.date_range_start, '%d-%m-%Y'), ' al ',
         strftime(d.date_range_end, '%d-%m-%Y'), ')') AS subject,
  concat('Hola ', d.owner_name, ',\n\nLe enviamos su Reporte Semanal Predictivo de Retail Analytics.\n\nPeríodo: ',
    strftime(d.date_range_start, '%d/%m/%Y'), ' al ', strftime(d.date_range_end, '%d/%m/%Y'), '\nGenerado: 01/07/2001 06:00\n\n',
    '── RESUMEN DE PREDICCIONES ──────────────────\n',
    '  Productos analizados  : ', CAST(d.unique_products AS VARCHAR), '\n',
    '  Alertas prioritarias  : ', CAST(d.unique_featured_products AS VARCHAR), '\n',
    '  Productos en Déficit  : ', CAST(d.deficit_products AS VARCHAR), '\n',
    '  Productos en Superávit: ', CAST(d.superavit_products AS VARCHAR), '\n',
    '  Productos en Normal   : ', CAST(d.neutral_products AS VARCHAR), '\n\n',
    CASE WHEN a.block IS NULL THEN '' ELSE concat('── TOP ALERTAS PRIORITARIAS ─────────────────\n', a.block, '\n\n') END,
    '{DIGEST_FOOTER}') AS body
FROM docs d LEFT JOIN (SELECT t.store_id, string_agg({item}, '\n' ORDER BY t.alert_rank) AS block FROM top t
  WHERE t.alert_rank <= 5 GROUP BY t.store_id) a ON a.store_id = d.store_id""",
        rx,
    )
    q["package_lines"] = with_views(
        ["scans_raw"],
        """SELECT store_id AS id_store, strftime(sale_date, '%d-%m-%Y') AS date, CAST(isodow(sale_date) AS INTEGER) AS day,
  CAST(DENSE_RANK() OVER (PARTITION BY store_id, sale_date ORDER BY block) - 1 AS INT) AS block_pos, block AS time,
  CAST(ROW_NUMBER() OVER (PARTITION BY store_id, sale_date, block ORDER BY barcode, amount) - 1 AS INT) AS product_pos,
  barcode, CAST(amount AS INT) AS amount FROM half""",
        {"scans": SCANS, "half": HALF},
    )


def build_dash(q: dict[str, str]) -> None:
    av = ["predictions", "sales"]
    ax = {"hist": HIST, "alerts": ALERTS}
    q["prediction_feed"] = with_views(
        ["predictions"],
        f"""SELECT store_id, product_name, category AS Category, image_url, strftime(objective_date, '%Y-%m-%d') AS objetive_date, prediction,
  feature, type, {dev_out()} FROM predictions WHERE objective_date > {AS_OF}""",
    )
    q["parse_alerts"] = with_views(
        av,
        f"""SELECT store_id, barcode AS src_barcode, objective_date AS src_date, COALESCE(product_name, 'Producto Desconocido') AS product_name,
  CASE WHEN prediction % 7 <> 0 THEN barcode ELSE '000000' END AS barcode,
  COALESCE(category, 'General') AS category, COALESCE(image_url, 'https://via.placeholder.com/150') AS image_url,
  CASE WHEN prediction % 10 = 0 THEN {AS_OF} WHEN prediction % 10 = 1 THEN DATE '2026-04-10' ELSE objective_date END AS objective_date,
  prediction, COALESCE(type, 'neutral') AS type, COALESCE(feature, false) AS feature, (floor((avg_weekly_sales) * 1e6 + 0.5) / 1e6) AS avg_weekly_sales
FROM alerts""",
        ax,
    )
    q["search_products"] = with_views(
        av,
        """SELECT store_id, barcode, product_name, objective_date, type,
  CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY strip_accents(lower(COALESCE(product_name, ''))), barcode, objective_date) AS INTEGER) AS list_rank
FROM alerts WHERE strpos(strip_accents(lower(COALESCE(product_name, ''))), 'jabon') > 0 OR strpos(lower(COALESCE(barcode, '')), 'jabon') > 0""",
        ax,
    )
    q["search_indexed"] = q["search_products"]
    q["parse_alerts_fields"] = with_views(
        av,
        """SELECT store_id, barcode AS src_barcode, objective_date AS src_date, CASE WHEN bad THEN 'Producto Desconocido' ELSE COALESCE(product_name, '-') END AS product_name,
  CASE WHEN bad OR prediction % 5 = 0 THEN 0 ELSE prediction END AS prediction, CASE WHEN bad OR prediction % 3 = 0 THEN false ELSE feature END AS feature,
  CASE WHEN bad THEN 'neutral' ELSE type END AS type, CASE WHEN bad THEN 0.0::DOUBLE ELSE 2.5::DOUBLE END AS avg_weekly_sales,
  CASE WHEN bad THEN '' ELSE concat_ws(',', CASE WHEN prediction % 5 = 0 THEN 'prediction' END, CASE WHEN prediction % 3 = 0 THEN 'feature' END) END AS failed, bad AS malformed
FROM (SELECT *, prediction % 11 = 0 AS bad FROM alerts)""",
        ax,
    )
    q["filter_alert_type"] = with_views(
        av,
        """SELECT store_id, barcode, product_name, objective_date, type,
  CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY strip_accents(lower(COALESCE(product_name, ''))) DESC, barcode, objective_date) AS INTEGER) AS list_rank
FROM alerts WHERE type = 'deficit'""",
        ax,
    )
    q["top_deviations"] = with_views(
        av,
        """SELECT store_id, bar_index, barcode, objective_date, substr(product_name, 1, 10) AS label, dev,
  CASE WHEN dev >= 0 THEN 'positive' ELSE 'negative' END AS color, CAST(trunc(MAX(abs(dev)) OVER (PARTITION BY store_id) * 1.2) AS INT) AS y_limit
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY abs(dev) DESC, product_name, barcode, objective_date) - 1 AS INTEGER) AS bar_index
  FROM (SELECT *, CAST(printf('%.2f', (CAST(prediction AS DOUBLE) - avg_weekly_sales) / avg_weekly_sales * 100.0) AS DOUBLE) + 0.0 AS dev
        FROM alerts WHERE avg_weekly_sales > 0) a) b WHERE bar_index < 25""",
        ax,
    )
    q["product_detail"] = with_views(
        ["predictions"],
        f"""SELECT store_id, barcode, product_name, category, image_url, objective_date, prediction, feature, type, {dev_out()} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, barcode ORDER BY objective_date) AS rn FROM predictions WHERE objective_date > {AS_OF}) t
WHERE rn = 1""",
    )
    q["ordered_alerts"] = with_views(
        ["predictions"],
        f"""SELECT {ROWCOLS}, CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY feature DESC, abs(percentage_average_deviation) DESC,
  objective_date, barcode) AS INTEGER) AS alert_position, {dev_out()} FROM upcoming""",
        {"upcoming": UPCOMING},
    )
    q["history_series"] = with_views(
        ["sales"],
        """SELECT store_id, barcode, strftime(sale_date, '%Y-%m-%d') AS date, volume,
  CAST(ROW_NUMBER() OVER (PARTITION BY store_id, barcode ORDER BY sale_date) - 1 AS INTEGER) AS idx,
  greatest(10, CAST(trunc(MAX(volume) OVER (PARTITION BY store_id, barcode) * 1.3) AS INT)) AS y_top
FROM (SELECT store_id, barcode, sale_date, CAST(SUM(amount) AS BIGINT) AS volume FROM sales GROUP BY 1, 2, 3) h""",
    )
    q["dashboard_stats"] = with_views(
        ["stores", "scans_raw", "package_queue", "predictions"],
        f"""SELECT s.store_id, COALESCE(t.n, 0) AS total_scans, COALESCE(a.n, 0) AS active_predictions, COALESCE(p.n, 0) AS pending_syncs,
  true AS is_online FROM stores s
LEFT JOIN (SELECT store_id, CAST(SUM(amount) AS BIGINT) AS n FROM scans GROUP BY store_id) t ON t.store_id = s.store_id
LEFT JOIN (SELECT store_id, COUNT(*) AS n FROM predictions WHERE objective_date > {AS_OF} GROUP BY store_id) a ON a.store_id = s.store_id
LEFT JOIN (SELECT q.client_id, COUNT(*) AS n FROM package_queue q
  LEFT JOIN (SELECT client_id, MIN(seq) AS f FROM package_queue WHERE length(trim(package_name)) > 0 AND outcome = 'network_error'
             GROUP BY client_id) x ON x.client_id = q.client_id
  WHERE length(trim(q.package_name)) > 0 AND (q.outcome = 'rejected' OR q.seq >= x.f) GROUP BY q.client_id) p ON p.client_id = s.store_id""",
        {"scans": SCANS},
    )
    q["weekly_series"] = with_views(
        ["sales", "predictions"],
        f"""SELECT COALESCE(a.store_id, p.store_id) AS store_id, COALESCE(a.d, p.d) AS series_date, strftime(COALESCE(a.d, p.d), '%d/%m') AS label,
  COALESCE(a.actual, 0) AS actual_sales, COALESCE(p.predicted, 0) AS predicted_sales
FROM (SELECT store_id, sale_date AS d, CAST(SUM(amount) AS BIGINT) AS actual FROM sales
      WHERE sale_date BETWEEN {AS_OF} - 6 AND {AS_OF} + 7 GROUP BY 1, 2) a
FULL OUTER JOIN (SELECT store_id, objective_date AS d, CAST(SUM(prediction) AS BIGINT) AS predicted FROM predictions
      WHERE objective_date BETWEEN {AS_OF} - 6 AND {AS_OF} + 7 GROUP BY 1, 2) p ON p.store_id = a.store_id AND p.d = a.d""",
    )
    q["gap_sessions"] = with_views(
        ["key_events"],
        """SELECT device, island, code, started, ended FROM (
  SELECT device, island, string_agg(key, '' ORDER BY ts, seq) FILTER (WHERE key IS NOT NULL AND key <> 'ENTER') AS code,
    MIN(ts) AS started, MAX(ts) AS ended, bool_or(COALESCE(key = 'ENTER', false)) AS term FROM (
    SELECT *, CAST(SUM(bnd) OVER (PARTITION BY device ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
      SELECT *, CASE WHEN rn = 1 OR date_diff('microsecond', pts, ts) > 3600000000 OR COALESCE(pkey = 'ENTER', false) THEN 1 ELSE 0 END AS bnd
      FROM (SELECT *, LAG(ts) OVER w AS pts, LAG(key) OVER w AS pkey, ROW_NUMBER() OVER w AS rn FROM key_events
            WINDOW w AS (PARTITION BY device ORDER BY ts, seq)) a) b) c
  GROUP BY device, island) d WHERE term AND length(code) > 0""",
    )
    q["scanner_codes"] = with_views(
        ["all_key_events"],
        """SELECT device, code, ended FROM (
  SELECT device, island, string_agg(key, '' ORDER BY ts, seq) FILTER (WHERE key IS NOT NULL AND key <> 'ENTER') AS code,
    MIN(ts) AS started, MAX(ts) AS ended, bool_or(COALESCE(key = 'ENTER', false)) AS term FROM (
    SELECT *, CAST(SUM(bnd) OVER (PARTITION BY device ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
      SELECT *, CASE WHEN rn = 1 OR date_diff('microsecond', pts, ts) > 3600000000 OR COALESCE(pkey = 'ENTER', false) THEN 1 ELSE 0 END AS bnd
      FROM (SELECT *, LAG(ts) OVER w AS pts, LAG(key) OVER w AS pkey, ROW_NUMBER() OVER w AS rn FROM all_key_events
            WINDOW w AS (PARTITION BY device ORDER BY ts, seq)) a) b) c
  GROUP BY device, island) d WHERE term AND length(code) > 0""",
    )
    base = "CASE p.category " + " ".join(
        f"WHEN '{c}' THEN {float(b)!r}" for c, b in
        {"Beverages": 15, "Snacks": 10, "Dairy": 8, "Cleaning": 4, "Chips": 7, "Sweets": 9, "Groceries": 6}.items()) + " ELSE 5.0 END"
    sens = "CASE p.category " + " ".join(
        f"WHEN '{c}' THEN {v!r}" for c, v in
        {"Beverages": 0.55, "Snacks": 0.10, "Dairy": -0.10, "Cleaning": 0.00, "Chips": 0.10, "Sweets": 0.00, "Groceries": 0.05}.items()) + " ELSE 0.0 END"
    prof = "CASE st.city WHEN 'Guadalajara' THEN {0} WHEN 'Ciudad de México' THEN {1} WHEN 'Monterrey' THEN {2} WHEN 'Puebla' THEN {3} WHEN 'Cancún' THEN {4} END"
    tb = prof.format("22.0", "17.0", "25.0", "16.0", "28.0")
    tr = prof.format("7.0", "5.0", "11.0", "5.0", "5.0")
    q["expected_demand"] = with_views(
        ["sales", "products", "stores"],
        f"""SELECT store_id, barcode, sale_date, time, (floor((t) * 1e6 + 0.5) / 1e6) AS temperature_used,
  (floor((base * 1.0 * dow * pay * (1.0 + sens * ((t - 20.0) / 15.0)) * wf) * 1e6 + 0.5) / 1e6) AS expected_demand FROM (
  SELECT s.store_id, s.barcode, s.sale_date, s.time, {base} AS base, {sens} AS sens,
    COALESCE(s.temperature, {tb} + sin(CAST(month(s.sale_date) - 3 AS DOUBLE) * pi() / 6.0) * {tr}) AS t,
    CASE WHEN isodow(s.sale_date) >= 6 THEN 1.30 WHEN isodow(s.sale_date) = 5 THEN 1.15 ELSE 1.0 END::DOUBLE AS dow,
    CASE WHEN day(s.sale_date) BETWEEN 13 AND 17 OR day(s.sale_date) >= 27 THEN 1.40 ELSE 1.0 END::DOUBLE AS pay,
    CASE s.weather_resume_wmo_code WHEN 95 THEN 0.75 WHEN 63 THEN 0.82 WHEN 51 THEN 0.91 ELSE 1.0 END::DOUBLE AS wf
  FROM sales s LEFT JOIN products p ON p.barcode = s.barcode LEFT JOIN stores st ON st.store_id = s.store_id) x""",
    )
