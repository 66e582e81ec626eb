"""The same results in plain SQL for DuckDB, written independently of the operators.

``_VIEWS`` holds named subqueries; a query text gets those it mentions, directly or not.
"""

from __future__ import annotations

import re

_VIEWS: dict[str, str] = {
    "fleet": """
        SELECT 'PLANT_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS plant_id,
               'INV_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS inverter_id,
               c_name AS inverter_name,
               CAST(floor(abs(c_acctbal) / 50) + 40 AS DOUBLE) AS rated_power_kw,
               (c_acctbal < 0 OR c_custkey IN (SELECT user_id FROM events)) AS active
        FROM customer""",
    "in_service": "SELECT plant_id, inverter_id, rated_power_kw FROM fleet WHERE active",
    "sites": """
        SELECT 'PLANT_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS plant_id,
               n_name AS plant_name, n_nationkey, n_regionkey, n_regionkey <> 4 AS active,
               (SELECT sum(rated_power_kw) FROM in_service s
                WHERE s.plant_id = 'PLANT_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS capacity_kw,
               CASE WHEN n_regionkey <> 3 THEN round(CAST(0.07 AS DOUBLE) + CAST(0.002 AS DOUBLE) * n_nationkey, 4)
               END AS ppa_rate_per_kwh
        FROM nation
        WHERE 'PLANT_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') IN (SELECT plant_id FROM in_service)""",
    "plant_ref": """
        SELECT p.plant_id, p.capacity_kw, CAST(count(i.inverter_id) AS INTEGER) AS configured_inverters
        FROM sites p LEFT JOIN in_service i ON i.plant_id = p.plant_id
        WHERE p.active GROUP BY p.plant_id, p.capacity_kw""",
    "telem": """
        SELECT CAST(e.event_id AS VARCHAR) AS event_id,
               'PLANT_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS plant_id,
               'INV_' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS inverter_id,
               value AS active_power_kw,
               CASE WHEN event_type = 'signup' THEN value
                    ELSE round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / CAST(3600 AS DOUBLE) * 10 + value, 3)
               END AS energy_today_kwh,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
               CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) * 12 AS DOUBLE) AS irradiance_wm2,
               CASE event_type WHEN 'error' THEN 'OFFLINE' WHEN 'signup' THEN 'WARNING' ELSE 'ONLINE' END AS status,
               CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS availability,
               ts AS event_time, e.event_id AS kafka_offset, CAST(c_nationkey AS INTEGER) AS kafka_partition,
               CAST(ts AS DATE) AS simulation_date
        FROM events e JOIN customer ON user_id = c_custkey""",
    # Records as they arrive: the damage applied to columns instead of to JSON text.
    "arrivals": """
        SELECT CASE WHEN k NOT IN (80, 81, 92) THEN event_id END AS event_id,
               CASE WHEN k NOT IN (80, 82, 92) THEN plant_id END AS plant_id,
               CASE WHEN k NOT IN (80, 83, 92) THEN inverter_id END AS inverter_id,
               plant_id || ':' || inverter_id AS kafka_key,
               CASE WHEN k = 86 THEN -1 WHEN k IN (80, 91, 92, 93) THEN NULL ELSE active_power_kw + copy END AS active_power_kw,
               CASE WHEN k = 87 THEN -1 WHEN k IN (80, 92, 93) THEN NULL ELSE energy_today_kwh END AS energy_today_kwh,
               CASE WHEN k = 88 THEN -1 WHEN k = 89 THEN 1600 WHEN k IN (80, 92, 93) THEN NULL ELSE irradiance_wm2 END AS irradiance_wm2,
               CASE WHEN k = 85 THEN 'BROKEN' WHEN k NOT IN (80, 92) THEN status END AS status,
               CASE WHEN k = 90 THEN 2 WHEN k IN (80, 92, 93) THEN NULL ELSE availability END AS availability,
               CASE WHEN k NOT IN (80, 84, 92) THEN event_time END AS event_time,
               event_time + copy * INTERVAL 1 SECOND AS kafka_timestamp,
               kafka_partition, kafka_offset + copy * 10000000000 AS kafka_offset,
               k NOT IN (80, 91, 92) AS payload_parsed, k, copy
        FROM telem, (SELECT unnest([0, 1]) AS copy)
        WHERE copy = 0 OR k BETWEEN 40 AND 44""",
    "judged": """
        SELECT *, CASE WHEN NOT payload_parsed THEN 'UNPARSEABLE_JSON'
                       WHEN event_id IS NULL THEN 'MISSING_EVENT_ID'
                       WHEN plant_id IS NULL THEN 'MISSING_PLANT_ID'
                       WHEN inverter_id IS NULL THEN 'MISSING_INVERTER_ID'
                       WHEN event_time IS NULL THEN 'INVALID_TIMESTAMP'
                       WHEN status IS NULL OR status NOT IN ('ONLINE', 'OFFLINE', 'WARNING') THEN 'INVALID_STATUS'
                       WHEN active_power_kw < 0 THEN 'NEGATIVE_ACTIVE_POWER'
                       WHEN energy_today_kwh < 0 THEN 'NEGATIVE_ENERGY'
                       WHEN irradiance_wm2 < 0 THEN 'NEGATIVE_IRRADIANCE'
                       WHEN irradiance_wm2 > 1500 THEN 'IRRADIANCE_OUT_OF_RANGE'
                       WHEN availability < 0 OR availability > 1 THEN 'AVAILABILITY_OUT_OF_RANGE'
                  END AS rejection_reason
        FROM arrivals""",
    "cleaned": """
        SELECT * REPLACE (coalesce(active_power_kw, 0) AS active_power_kw,
                          coalesce(energy_today_kwh, 0) AS energy_today_kwh,
                          coalesce(irradiance_wm2, 0) AS irradiance_wm2,
                          coalesce(availability, CASE WHEN status = 'OFFLINE' THEN 0 ELSE 1 END) AS availability)
        FROM judged WHERE rejection_reason IS NULL""",
    "trusted": """
        SELECT * FROM cleaned
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY kafka_timestamp, kafka_partition, kafka_offset) = 1""",
    "latest": """
        SELECT * FROM telem
        QUALIFY row_number() OVER (PARTITION BY plant_id, inverter_id ORDER BY event_time DESC, kafka_offset DESC) = 1""",
    "plant_live_rows": """
        SELECT cur.plant_id, b.window_start, b.window_end, current_power_kw, avg_power_kw,
               CASE WHEN irr >= 150 THEN capacity_kw * least(irr / 1000, 1) END AS expected_power_kw,
               irr AS avg_irradiance_wm2,
               online / nullif(CAST(coalesce(configured_inverters, reporting) AS DOUBLE), 0) * 100 AS availability_pct,
               online AS online_inverters,
               greatest(coalesce(configured_inverters, reporting) - online, 0) AS offline_inverters
        FROM (SELECT plant_id, sum(active_power_kw) AS current_power_kw, avg(irradiance_wm2) AS irr,
                     count(*) FILTER (status <> 'OFFLINE' AND availability > 0) AS online, count(*) AS reporting
              FROM latest GROUP BY 1) cur
        JOIN (SELECT plant_id, min(event_time) AS window_start, max(event_time) AS window_end
              FROM telem GROUP BY 1) b ON b.plant_id = cur.plant_id
        JOIN (SELECT plant_id, avg(p) AS avg_power_kw
              FROM (SELECT plant_id, event_time, sum(active_power_kw) AS p FROM telem GROUP BY 1, 2)
              GROUP BY 1) a ON a.plant_id = cur.plant_id
        LEFT JOIN plant_ref r ON r.plant_id = cur.plant_id""",
    "plant_rows": """
        SELECT *, CASE WHEN expected_power_kw > 0 THEN current_power_kw / expected_power_kw * 100 END AS performance_pct,
               CASE WHEN expected_power_kw IS NOT NULL THEN greatest(expected_power_kw - current_power_kw, 0) END AS estimated_loss_kw
        FROM plant_live_rows""",
    "span_events_6": """
        SELECT *, make_timestamp(CAST(epoch_us(event_time) // 21600000000 * 21600000000 AS BIGINT)) AS w0,
               make_timestamp(CAST(epoch_us(event_time) // 21600000000 * 21600000000 + 21600000000 AS BIGINT)) AS w1
        FROM telem""",
    "span_events_3": """
        SELECT t.*, make_timestamp(CAST((epoch_us(event_time) // 10800000000 - s) * 10800000000 AS BIGINT)) AS w0,
               make_timestamp(CAST((epoch_us(event_time) // 10800000000 - s + 2) * 10800000000 AS BIGINT)) AS w1
        FROM telem t, (SELECT unnest([0, 1]) AS s)""",
    "span_rows": "",
    "portfolio_rows": """
        SELECT window_start, window_end, sum(current_power_kw) AS current_power_kw, sum(avg_power_kw) AS avg_power_kw,
               sum(expected_power_kw) AS expected_power_kw,
               CAST(sum(online_inverters) AS BIGINT) AS online_inverters,
               CAST(sum(offline_inverters) AS BIGINT) AS offline_inverters,
               sum(online_inverters) / nullif(CAST(sum(online_inverters) + sum(offline_inverters) AS DOUBLE), 0) * 100 AS availability_pct,
               sum(current_power_kw) FILTER (expected_power_kw IS NOT NULL) / nullif(sum(expected_power_kw), 0) * 100 AS performance_pct,
               sum(estimated_loss_kw) AS estimated_loss_kw
        FROM span_rows GROUP BY 1, 2""",
    "ticks": """
        SELECT CAST(event_time AS DATE) AS frame, max(event_time) AS observed_at,
               row_number() OVER (ORDER BY CAST(event_time AS DATE)) AS tick
        FROM telem GROUP BY 1""",
    # Every inverter in service at every observation; the run-length form is not used here.
    "states": """
        SELECT i.plant_id, i.inverter_id, k.tick, k.observed_at, l.event_time,
               i.rated_power_kw * least(coalesce(l.irradiance_wm2, 0) / 1000, 1) AS expected,
               l.active_power_kw, l.irradiance_wm2, l.status, l.availability
        FROM in_service i CROSS JOIN ticks k
        LEFT JOIN (SELECT * FROM telem QUALIFY row_number() OVER (
                       PARTITION BY plant_id, inverter_id, simulation_date
                       ORDER BY event_time DESC, kafka_offset DESC) = 1) l
          ON l.plant_id = i.plant_id AND l.inverter_id = i.inverter_id AND l.simulation_date = k.frame""",
    "diagnosed": """
        SELECT *, CASE WHEN event_time IS NULL THEN 'TELEMETRY_GAP'
                       WHEN status = 'OFFLINE' OR availability = 0 THEN 'INVERTER_OFFLINE'
                       WHEN irradiance_wm2 >= 150 AND expected > 0 AND active_power_kw / expected * 100 < 80
                       THEN 'UNDERPERFORMANCE' END AS alert_type
        FROM states""",
    "faults": """
        SELECT plant_id, inverter_id, tick, observed_at, alert_type,
               CASE WHEN alert_type = 'UNDERPERFORMANCE' THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
               CASE WHEN alert_type = 'TELEMETRY_GAP' THEN 0
                    ELSE greatest(expected - coalesce(active_power_kw, 0), 0) END AS loss_kw,
               CASE alert_type
                   WHEN 'TELEMETRY_GAP' THEN 'No telemetry received from inverter ' || inverter_id || ' at plant ' || plant_id
                   WHEN 'INVERTER_OFFLINE' THEN 'Inverter ' || inverter_id || ' at plant ' || plant_id || ' reported OFFLINE'
                   ELSE 'Inverter ' || inverter_id || ' at plant ' || plant_id || ' generating '
                        || CAST(round(active_power_kw / expected * 100, 1) AS VARCHAR)
                        || '% of expected under current irradiance' END AS message
        FROM diagnosed WHERE alert_type IS NOT NULL""",
    "runs": """
        SELECT plant_id, inverter_id, alert_type, arg_max(severity, tick) AS severity,
               arg_max(message, tick) AS message, min(observed_at) AS first_observed_at,
               max(observed_at) AS last_observed_at, count(*) AS observation_count,
               sum(loss_kw) AS sum_loss_kw,
               (SELECT k.observed_at FROM ticks k WHERE k.tick = max(f.tick) + 1) AS ended_at
        FROM (SELECT *, tick - row_number() OVER (PARTITION BY plant_id, inverter_id, alert_type ORDER BY tick) AS island
              FROM faults) f
        GROUP BY plant_id, inverter_id, alert_type, island""",
    "day_list": """
        SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS d
        FROM events""",
    "expectations": """
        SELECT p.*, d FROM sites p, day_list WHERE NOT (n_regionkey = 2 AND day(d) = 13)""",
    "ref": """
        SELECT d AS simulation_date, plant_id, capacity_kw AS plant_capacity_kw,
               round(capacity_kw * (CAST(0.3 AS DOUBLE) + CAST(0.04 AS DOUBLE) * day(d)), 3) AS expected_generation_kwh,
               round(capacity_kw * CAST(0.9 AS DOUBLE), 3) AS expected_peak_power_kw,
               CAST(5.2 AS DOUBLE) AS forecast_irradiance_kwh_m2,
               round(CAST(0.07 AS DOUBLE) + CAST(0.002 AS DOUBLE) * n_nationkey, 4) AS ppa_rate_per_kwh,
               n_nationkey + 1 = day(d) AS maintenance_flag, 'v1' AS source_version
        FROM expectations""",
    "alert_rows": """
        SELECT sha256(concat_ws('|', r.plant_id, r.inverter_id, r.alert_type, CAST(epoch_us(first_observed_at) AS VARCHAR))) AS id,
               r.plant_id, r.inverter_id, r.alert_type, r.severity, r.message, first_observed_at AS started_at, ended_at,
               CASE WHEN ended_at IS NULL THEN 'ACTIVE' ELSE 'RESOLVED' END AS status,
               sum_loss_kw / observation_count * ((epoch_us(last_observed_at) - epoch_us(first_observed_at)) / 1e6 / 3600) AS estimated_loss_kwh,
               sum_loss_kw / observation_count * ((epoch_us(last_observed_at) - epoch_us(first_observed_at)) / 1e6 / 3600)
                   * f.ppa_rate_per_kwh AS estimated_revenue_loss
        FROM runs r LEFT JOIN ref f ON f.plant_id = r.plant_id AND f.simulation_date = CAST(first_observed_at AS DATE)
        WHERE epoch_us(last_observed_at) - epoch_us(first_observed_at) >= 3600000000""",
    "alerts_per_day": """
        SELECT CAST(started_at AS DATE) AS simulation_date, plant_id, count(*) AS alert_count
        FROM alert_rows GROUP BY 1, 2""",
    "increments": """
        SELECT *, CASE WHEN prev IS NULL OR energy_today_kwh < prev THEN energy_today_kwh
                       ELSE energy_today_kwh - prev END AS energy_increment_kwh
        FROM (SELECT *, lag(energy_today_kwh) OVER (PARTITION BY plant_id, inverter_id, simulation_date
                                                    ORDER BY event_time, kafka_offset) AS prev FROM telem)""",
    "per_inverter": """
        SELECT simulation_date, plant_id, inverter_id, sum(energy_increment_kwh) AS actual_generation_kwh,
               count(*) AS observation_count, count(*) FILTER (status = 'ONLINE') AS online_observations,
               count(*) FILTER (status = 'OFFLINE') AS offline_observations
        FROM increments GROUP BY 1, 2, 3""",
    "actuals": """
        SELECT simulation_date, plant_id, sum(actual_generation_kwh) AS actual_generation_kwh,
               CAST(sum(online_observations) AS DOUBLE) / sum(observation_count) * 100 AS availability_pct,
               CAST(sum(offline_observations) AS DOUBLE) * 3 / 60 AS downtime_minutes,
               CAST(sum(observation_count) AS BIGINT) AS observation_count,
               count(DISTINCT inverter_id) AS reporting_inverters
        FROM per_inverter GROUP BY 1, 2""",
    "recon_base": """
        SELECT r.simulation_date, r.plant_id, coalesce(a.actual_generation_kwh, 0) AS actual_generation_kwh,
               r.expected_generation_kwh,
               coalesce(a.actual_generation_kwh, 0) / r.expected_generation_kwh * 100 AS performance_pct,
               CASE WHEN a.plant_id IS NULL THEN 0 ELSE a.availability_pct END AS availability_pct,
               coalesce(a.downtime_minutes, 0) AS downtime_minutes,
               greatest(r.expected_generation_kwh - coalesce(a.actual_generation_kwh, 0), 0) AS estimated_lost_energy_kwh,
               r.ppa_rate_per_kwh, r.maintenance_flag, a.plant_id IS NULL AS silent
        FROM ref r LEFT JOIN actuals a ON a.plant_id = r.plant_id AND a.simulation_date = r.simulation_date""",
    "recon": """
        SELECT b.*, actual_generation_kwh * ppa_rate_per_kwh AS estimated_actual_revenue,
               estimated_lost_energy_kwh * ppa_rate_per_kwh AS estimated_lost_revenue,
               coalesce(n.alert_count, 0) AS alert_count, performance_pct > 300 AS implausible
        FROM recon_base b LEFT JOIN alerts_per_day n ON n.plant_id = b.plant_id AND n.simulation_date = b.simulation_date""",
    "unvalued": """
        SELECT a.simulation_date, a.plant_id FROM actuals a
        WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE r.plant_id = a.plant_id AND r.simulation_date = a.simulation_date)""",
    # The stored summary of the serving queries: as recon, before alerts are counted.
    "summary": """
        SELECT b.*, actual_generation_kwh * ppa_rate_per_kwh AS estimated_actual_revenue,
               estimated_lost_energy_kwh * ppa_rate_per_kwh AS estimated_lost_revenue,
               CAST(0 AS BIGINT) AS alert_count
        FROM recon_base b WHERE performance_pct <= 300""",
    "totals": """
        SELECT simulation_date, sum(actual_generation_kwh) AS actual_generation_kwh,
               sum(expected_generation_kwh) AS expected_generation_kwh,
               sum(estimated_lost_energy_kwh) AS lost_energy_kwh, sum(estimated_actual_revenue) AS actual_revenue,
               sum(estimated_lost_revenue) AS lost_revenue, count(*) AS plant_count,
               sum(actual_generation_kwh) / nullif(sum(expected_generation_kwh), 0) * 100 AS performance_pct
        FROM summary GROUP BY 1""",
    "ranked": """
        SELECT s.simulation_date, s.plant_id, p.plant_name, performance_pct,
               row_number() OVER (PARTITION BY simulation_date ORDER BY performance_pct, s.plant_id) AS up,
               row_number() OVER (PARTITION BY simulation_date ORDER BY performance_pct DESC, s.plant_id DESC) AS down
        FROM summary s JOIN sites p ON p.plant_id = s.plant_id WHERE performance_pct IS NOT NULL""",
    "feed_rows": """
        SELECT d AS feed_date, CAST(n_nationkey * 10 + copy + 1 AS BIGINT) AS position,
               CASE WHEN n_nationkey = 4 AND day(d) = 6 THEN '' WHEN n_nationkey = 5 AND day(d) = 6 THEN 'PLANT_99'
                    ELSE plant_id END AS plant_id, n_nationkey AS n, day(d) AS nth, copy, d
        FROM expectations, (SELECT unnest([0, 1]) AS copy)
        WHERE copy = 0 OR (n_nationkey = 3 AND day(d) = 5)""",
    "feed_faults": """
        SELECT feed_date, position, plant_id, f.problem, f.detail FROM feed_rows JOIN (VALUES
            (4, 6, 0, 'PLANT_ID_MISSING', ''), (3, 5, 1, 'DUPLICATE_PLANT', 'PLANT_03'),
            (6, 6, 0, 'DATE_MISSING', ''), (7, 6, 0, 'DATE_INVALID', '06/01/2024'),
            (9, 6, 0, 'NOT_A_NUMBER', 'plant_capacity_kw=abc'), (10, 6, 0, 'NUMBER_MISSING', 'plant_capacity_kw=nan'),
            (11, 6, 0, 'CAPACITY_NOT_POSITIVE', '0.0'), (12, 6, 0, 'SUN_HOURS_IMPLAUSIBLE', '56001.0'),
            (13, 6, 0, 'GENERATION_NOT_POSITIVE', '-5.0'), (14, 6, 0, 'PEAK_ABOVE_CAPACITY', '4001.0'),
            (15, 6, 0, 'PEAK_NOT_POSITIVE', '0.0'), (16, 6, 0, 'IRRADIANCE_NEGATIVE', '-0.5'),
            (17, 6, 0, 'RATE_NEGATIVE', '-0.1'), (18, 6, 0, 'NOT_A_BOOLEAN', 'maybe'),
            (21, 6, 0, 'SOURCE_VERSION_MISSING', '')) f(n, nth, copy, problem, detail)
          ON f.n = feed_rows.n AND f.nth = feed_rows.nth AND f.copy = feed_rows.copy
        UNION ALL
        SELECT DISTINCT feed_date, NULL, NULL, CASE nth WHEN 7 THEN 'DATES_MIXED' ELSE 'DATE_NOT_REQUESTED' END,
               CASE nth WHEN 7 THEN '2024-01-07..2024-01-08' ELSE '2024-01-10..2024-01-10' END
        FROM feed_rows
        WHERE nth = 9 OR (nth = 7 AND 8 IN (SELECT n_nationkey FROM sites))""",
    "script": """
        SELECT ['INV_UNDERPERFORMANCE', 'INV_OFFLINE', 'TELEMETRY_GAP', 'RECOVERY'][least(n_regionkey + 1, 4)] AS scenario,
               n_nationkey * 12 * 288 AS w_start, (n_nationkey * 12 + 9) * 288 AS w_end,
               CASE WHEN n_nationkey > 0 THEN 'PLANT_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS w_plant,
               CASE WHEN n_regionkey = 1 THEN 'INV_' || lpad(CAST((SELECT min(c_custkey) FROM customer
                    WHERE c_nationkey = n_nationkey) AS VARCHAR), 8, '0') END AS w_inverter,
               CASE WHEN n_regionkey = 0 THEN CAST(0.45 AS DOUBLE) END AS power_factor
        FROM nation""",
}

# The per-window version of plant_rows, for either way of cutting time.
_SPAN_ROWS = """
        SELECT *, CASE WHEN expected_power_kw > 0 THEN current_power_kw / expected_power_kw * 100 END AS performance_pct,
               CASE WHEN expected_power_kw IS NOT NULL THEN greatest(expected_power_kw - current_power_kw, 0) END AS estimated_loss_kw
        FROM (SELECT cur.plant_id, cur.w0 AS window_start, cur.w1 AS window_end, current_power_kw, avg_power_kw,
                     CASE WHEN irr >= 150 THEN capacity_kw * least(irr / 1000, 1) END AS expected_power_kw,
                     irr AS avg_irradiance_wm2,
                     online / nullif(CAST(coalesce(configured_inverters, reporting) AS DOUBLE), 0) * 100 AS availability_pct,
                     online AS online_inverters,
                     greatest(coalesce(configured_inverters, reporting) - online, 0) AS offline_inverters
              FROM (SELECT plant_id, w0, w1, sum(active_power_kw) AS current_power_kw, avg(irradiance_wm2) AS irr,
                           count(*) FILTER (status <> 'OFFLINE' AND availability > 0) AS online, count(*) AS reporting
                    FROM (SELECT * FROM {events} QUALIFY row_number() OVER (
                              PARTITION BY plant_id, inverter_id, w0 ORDER BY event_time DESC, kafka_offset DESC) = 1)
                    GROUP BY 1, 2, 3) cur
              JOIN (SELECT plant_id, w0, avg(p) AS avg_power_kw
                    FROM (SELECT plant_id, w0, event_time, sum(active_power_kw) AS p FROM {events} GROUP BY 1, 2, 3)
                    GROUP BY 1, 2) a ON a.plant_id = cur.plant_id AND a.w0 = cur.w0
              LEFT JOIN plant_ref r ON r.plant_id = cur.plant_id)"""
_VIEWS["span_rows"] = _SPAN_ROWS.format(events="span_events_6")
_VIEWS["slide_rows"] = _SPAN_ROWS.format(events="span_events_3")


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _day(c: str = "simulation_date") -> str:
    return f"CAST({c} AS VARCHAR) AS {c}"


_EVENT = ("event_id, plant_id, inverter_id, round(active_power_kw, 6) AS active_power_kw, "
          "round(energy_today_kwh, 6) AS energy_today_kwh, round(irradiance_wm2, 6) AS irradiance_wm2, "
          "status, round(availability, 6) AS availability, event_time, kafka_offset")
_MEASURES = _r("current_power_kw", "avg_power_kw", "expected_power_kw", "availability_pct",
               "performance_pct", "estimated_loss_kw") + ", online_inverters, offline_inverters"
_PLANT_METRICS = f"plant_id, window_start, window_end, {_r('avg_irradiance_wm2')}, {_MEASURES}"
_RUN = ("plant_id, inverter_id, alert_type, severity, message, first_observed_at, last_observed_at, "
        f"observation_count, {_r('sum_loss_kw')}, ended_at")
_ALERT = ("id, plant_id, inverter_id, alert_type, severity, message, started_at, ended_at, status, "
          + _r("estimated_loss_kwh", "estimated_revenue_loss"))
_SUMMARY = (f"{_day()}, plant_id, " + _r(
    "actual_generation_kwh", "expected_generation_kwh", "performance_pct", "availability_pct",
    "downtime_minutes", "estimated_lost_energy_kwh", "ppa_rate_per_kwh", "estimated_actual_revenue",
    "estimated_lost_revenue") + ", alert_count, maintenance_flag")
_TOTALS = f"""{_day()}, {_r('actual_generation_kwh', 'expected_generation_kwh', 'lost_energy_kwh',
              'actual_revenue', 'lost_revenue')}, plant_count, {_r('performance_pct')}"""
_AS_OF = "TIMESTAMP '2024-01-30 23:59:00'"


def _fresh(c: str, seconds: int) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'NO_DATA' WHEN epoch_us({_AS_OF}) - epoch_us({c}) > {seconds * 1000000} "
            "THEN 'STALE' ELSE 'LIVE' END AS data_status")


_QUERIES: dict[str, str] = {
    "parse_validate_reasons": "SELECT kafka_offset, event_id, event_time, payload_parsed, rejection_reason FROM judged",
    "normalize": f"SELECT {_EVENT} FROM cleaned",
    "valid_events": f"SELECT {_EVENT} FROM trusted",
    "dedup_events": """
        SELECT event_id, kafka_offset, round(active_power_kw, 6) AS active_power_kw FROM arrivals
        WHERE event_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY kafka_timestamp, kafka_offset) = 1""",
    "quarantine_records": """
        SELECT kafka_key AS key, CAST(10 AS INTEGER) AS fields, rejection_reason, event_id, plant_id, inverter_id,
               'telemetry' AS source_topic, kafka_partition AS source_partition, kafka_offset AS source_offset,
               k = 92 AS payload_missing
        FROM judged WHERE rejection_reason IS NOT NULL""",
    "quarantine_counts": """
        SELECT rejection_reason, count(*) AS records FROM judged WHERE rejection_reason IS NOT NULL GROUP BY 1""",
    "quarantine_rate": """
        SELECT date_trunc('hour', kafka_timestamp) AS window_start, rejection_reason, count(*) AS records,
               round(count(*) / CAST(3600 AS DOUBLE), 6) AS per_second
        FROM judged WHERE rejection_reason IS NOT NULL GROUP BY 1, 2""",
    "producer_contract": """
        SELECT a.kafka_offset, CASE
                 WHEN k IN (80, 91, 92) THEN 'SCHEMA_VIOLATION'
                 WHEN i.inverter_id IS NULL THEN 'UNKNOWN_ASSET'
                 WHEN k = 86 THEN 'NEGATIVE_ACTIVE_POWER' WHEN k = 87 THEN 'NEGATIVE_ENERGY'
                 WHEN k = 88 THEN 'NEGATIVE_IRRADIANCE' WHEN k = 89 THEN 'IRRADIANCE_OUT_OF_RANGE'
                 WHEN k = 85 THEN 'INVALID_STATUS' WHEN k = 90 THEN 'AVAILABILITY_OUT_OF_RANGE'
                 WHEN k IN (81, 84, 91, 93, 94) THEN 'SCHEMA_VIOLATION'
                 WHEN a.active_power_kw > i.rated_power_kw THEN 'POWER_EXCEEDS_RATING'
                 WHEN a.status = 'OFFLINE' AND (a.availability <> 0 OR a.active_power_kw <> 0)
                   OR a.status <> 'OFFLINE' AND a.availability <> 1 THEN 'STATUS_INCONSISTENT' END AS source_reason,
               CASE WHEN k IN (80, 91, 92) THEN '<record>' WHEN k = 81 THEN 'event_id' WHEN k = 82 THEN 'plant_id'
                    WHEN k = 83 THEN 'inverter_id' WHEN k = 84 THEN 'timestamp' WHEN k = 85 THEN 'status'
                    WHEN k = 86 THEN 'active_power_kw' WHEN k = 87 THEN 'energy_today_kwh'
                    WHEN k IN (88, 89) THEN 'irradiance_wm2' WHEN k = 90 THEN 'availability'
                    WHEN k = 93 THEN 'active_power_kw,availability,energy_today_kwh,irradiance_wm2'
                    WHEN k = 94 THEN '+extra' ELSE '' END AS violations
        FROM arrivals a LEFT JOIN fleet i ON i.plant_id = a.plant_id AND i.inverter_id = a.inverter_id""",
    "archive_rows": f"""
        SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS simulation_date, plant_id, event_id, inverter_id,
               {_r('energy_today_kwh')}, round(k / CAST(2 AS DOUBLE) + 20, 6) AS module_temp_c,
               kafka_partition, kafka_offset FROM trusted""",
    "latest_reading": f"SELECT {_EVENT} FROM latest",
    "plant_timeline": """
        SELECT plant_id, event_time, round(sum(active_power_kw), 6) AS plant_power_kw FROM telem GROUP BY 1, 2""",
    "plant_metrics": f"SELECT {_PLANT_METRICS} FROM plant_rows",
    "windowed_plant_metrics": f"SELECT {_PLANT_METRICS} FROM span_rows",
    "sliding_plant_metrics": f"SELECT {_PLANT_METRICS} FROM slide_rows",
    "portfolio_metrics": f"""
        SELECT min(window_start) AS window_start, max(window_end) AS window_end,
               round(sum(current_power_kw), 6) AS current_power_kw, round(sum(avg_power_kw), 6) AS avg_power_kw,
               round(sum(expected_power_kw), 6) AS expected_power_kw,
               CAST(sum(online_inverters) AS BIGINT) AS online_inverters,
               CAST(sum(offline_inverters) AS BIGINT) AS offline_inverters,
               round(sum(online_inverters) / CAST(sum(online_inverters) + sum(offline_inverters) AS DOUBLE) * 100, 6) AS availability_pct,
               round(sum(current_power_kw) FILTER (expected_power_kw IS NOT NULL) / sum(expected_power_kw) * 100, 6) AS performance_pct,
               round(sum(estimated_loss_kw), 6) AS estimated_loss_kw
        FROM plant_rows""",
    "windowed_portfolio_metrics": f"SELECT window_start, window_end, {_MEASURES} FROM portfolio_rows",
    "last_n_windows": f"""
        SELECT window_end, {_r('current_power_kw', 'expected_power_kw')} FROM portfolio_rows
        ORDER BY window_end DESC LIMIT 50""",
    "alert_conditions": f"""
        SELECT plant_id, inverter_id, alert_type,
               CASE WHEN alert_type = 'UNDERPERFORMANCE' THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
               CASE alert_type
                   WHEN 'TELEMETRY_GAP' THEN 'No telemetry received from inverter ' || inverter_id || ' at plant ' || plant_id
                   WHEN 'INVERTER_OFFLINE' THEN 'Inverter ' || inverter_id || ' at plant ' || plant_id || ' reported OFFLINE'
                   ELSE 'Inverter ' || inverter_id || ' at plant ' || plant_id || ' generating '
                        || CAST(round(power / expected * 100, 1) AS VARCHAR) || '% of expected under current irradiance' END AS message,
               round(CASE WHEN alert_type = 'TELEMETRY_GAP' THEN 0 ELSE greatest(expected - power, 0) END, 6) AS loss_kw,
               (SELECT max(event_time) FROM telem) AS observed_at
        FROM (SELECT *, CASE WHEN l_time IS NULL THEN 'TELEMETRY_GAP'
                             WHEN status = 'OFFLINE' OR availability = 0 THEN 'INVERTER_OFFLINE'
                             WHEN irr >= 150 AND power / expected * 100 < 80 THEN 'UNDERPERFORMANCE' END AS alert_type
              FROM (SELECT i.plant_id, i.inverter_id, l.event_time AS l_time, l.status, l.availability,
                           l.irradiance_wm2 AS irr, l.active_power_kw AS power,
                           i.rated_power_kw * least(coalesce(l.irradiance_wm2, 0) / 1000, 1) AS expected
                    FROM in_service i LEFT JOIN latest l ON l.plant_id = i.plant_id AND l.inverter_id = i.inverter_id))
        WHERE alert_type IS NOT NULL""",
    "alert_runs": f"SELECT {_RUN} FROM runs",
    "alert_incidents": f"SELECT {_ALERT} FROM alert_rows",
    "alert_counts": f"SELECT {_day()}, plant_id, alert_count FROM alerts_per_day",
    "active_alert_count": "SELECT count(*) AS active_alerts FROM alert_rows WHERE status = 'ACTIVE'",
    "alerts_listing": f"""
        SELECT {_ALERT} FROM alert_rows WHERE status = 'RESOLVED' AND severity = 'WARNING'
        ORDER BY started_at DESC, id LIMIT 200""",
    "energy_increments": f"""
        SELECT event_id, plant_id, inverter_id, event_time, {_r('energy_today_kwh', 'energy_increment_kwh')} FROM increments""",
    "inverter_actuals": f"""
        SELECT {_day()}, plant_id, inverter_id, {_r('actual_generation_kwh')}, observation_count,
               online_observations, offline_observations FROM per_inverter""",
    "plant_actuals": f"""
        SELECT {_day()}, plant_id, {_r('actual_generation_kwh', 'availability_pct', 'downtime_minutes')},
               observation_count, reporting_inverters FROM actuals""",
    "running_meter": f"""
        SELECT event_id, inverter_id, {_day()}, event_time,
               round(sum(active_power_kw * CAST(0.24 AS DOUBLE)) OVER (
                   PARTITION BY plant_id, inverter_id, simulation_date ORDER BY event_time, kafka_offset
                   ROWS UNBOUNDED PRECEDING), 6) AS meter_kwh FROM telem""",
    "archive_presence": f"""
        SELECT {_day()}, count(*) AS events, count(DISTINCT plant_id) AS plants FROM telem GROUP BY simulation_date""",
    "reference_problems": """
        SELECT CAST(feed_date AS VARCHAR) AS feed_date, position, plant_id, problem, detail FROM feed_faults
        UNION ALL
        SELECT CAST(d AS VARCHAR), NULL, p.plant_id, 'PLANT_NOT_IN_FEED', '' FROM sites p, day_list
        WHERE p.active AND NOT EXISTS (SELECT 1 FROM feed_rows f WHERE f.d = day_list.d AND f.plant_id = p.plant_id)
        UNION ALL
        SELECT DISTINCT CAST(d AS VARCHAR), NULL, f.plant_id, 'PLANT_UNKNOWN', '' FROM feed_rows f
        WHERE f.plant_id <> '' AND f.plant_id NOT IN (SELECT plant_id FROM sites WHERE active)""",
    "reference_rows": f"""
        SELECT CAST(feed_date AS VARCHAR) AS simulation_date, plant_id, CAST(4000 AS DOUBLE) AS plant_capacity_kw,
               CAST(20000 AS DOUBLE) AS expected_generation_kwh, CAST(3800 AS DOUBLE) AS expected_peak_power_kw,
               CAST(5.2 AS DOUBLE) AS forecast_irradiance_kwh_m2, CAST(0.15 AS DOUBLE) AS ppa_rate_per_kwh,
               n = 19 AS maintenance_flag, 'v1' AS source_version
        FROM feed_rows WHERE feed_date NOT IN (SELECT feed_date FROM feed_faults)""",
    "reconcile_summary": f"SELECT {_SUMMARY} FROM recon WHERE NOT implausible",
    "reconcile_published": f"""
        SELECT {_SUMMARY} FROM recon
        WHERE simulation_date NOT IN (SELECT simulation_date FROM recon WHERE implausible
                                      UNION SELECT simulation_date FROM unvalued)""",
    "reconcile_problems": f"""
        SELECT {_day()}, plant_id, 'IMPLAUSIBLE_PERFORMANCE' AS remark, {_r('performance_pct')} FROM recon WHERE implausible
        UNION ALL SELECT {_day()}, plant_id, 'NO_REFERENCE_ROW', NULL FROM unvalued""",
    "reconcile_warnings": f"""
        SELECT {_day()}, plant_id, 'NO_TELEMETRY' AS remark, {_r('performance_pct')} FROM recon WHERE silent
        UNION ALL SELECT {_day()}, plant_id, 'ABOVE_FORECAST', {_r('performance_pct')} FROM recon
                  WHERE NOT implausible AND performance_pct > 100
        UNION ALL SELECT {_day()}, plant_id, 'MAINTENANCE', {_r('performance_pct')} FROM recon
                  WHERE NOT implausible AND maintenance_flag""",
    "dq_checks": f"""
        SELECT CAST(d AS VARCHAR) AS simulation_date, p.plant_id, 'PLANT_NOT_SUMMARISED' AS problem
        FROM sites p, day_list WHERE p.active AND NOT EXISTS (
            SELECT 1 FROM summary s WHERE s.plant_id = p.plant_id AND s.simulation_date = d)
        UNION ALL
        SELECT CAST(r.simulation_date AS VARCHAR), NULL, 'ROW_COUNT_DIFFERS'
        FROM (SELECT simulation_date, count(*) AS n FROM ref GROUP BY 1) r
        LEFT JOIN (SELECT simulation_date, count(*) AS n FROM summary GROUP BY 1) s USING (simulation_date)
        WHERE r.n <> coalesce(s.n, 0)
        UNION ALL
        SELECT {_day()}, plant_id, 'PERFORMANCE_INCONSISTENT' FROM summary WHERE maintenance_flag""",
    "constraint_checks": """
        SELECT t AS "table", 'FOREIGN_KEY' AS "check", plant_id AS key
        FROM (SELECT DISTINCT 'daily_plant_summary' AS t, plant_id FROM summary
              UNION ALL SELECT DISTINCT 'daily_reference', plant_id FROM ref
              UNION ALL SELECT DISTINCT 'plant_metrics', plant_id FROM span_rows
              UNION ALL SELECT DISTINCT 'inverters', plant_id FROM fleet)
        WHERE plant_id NOT IN (SELECT plant_id FROM sites WHERE active)""",
    "alert_constraints": """
        SELECT DISTINCT 'alerts' AS "table", 'FOREIGN_KEY' AS "check", plant_id AS key FROM alert_rows
        WHERE plant_id NOT IN (SELECT plant_id FROM sites WHERE active)""",
    "forecast_feed": """
        WITH own AS (SELECT plant_id, hour(event_time) AS h, avg(irradiance_wm2) AS sun, avg(k / CAST(2 AS DOUBLE) + 20) AS heat FROM telem GROUP BY 1, 2),
             every AS (SELECT hour(event_time) AS h, avg(irradiance_wm2) AS sun, avg(k / CAST(2 AS DOUBLE) + 20) AS heat FROM telem GROUP BY 1),
             rated AS (SELECT plant_id, sum(rated_power_kw) AS kw FROM in_service GROUP BY 1),
             usual AS (SELECT r.plant_id, r.kw, coalesce(o.sun, e.sun) AS sun, coalesce(o.heat, e.heat, 0) AS heat
                       FROM rated r CROSS JOIN every e LEFT JOIN own o ON o.plant_id = r.plant_id AND o.h = e.h),
             power AS (SELECT plant_id, sun, kw * least(sun / 1000, 1) * greatest(1 - greatest(heat - 25, 0) * CAST(0.004 AS DOUBLE), CAST(0.8 AS DOUBLE)) AS p FROM usual)
        SELECT CAST(d AS VARCHAR) AS simulation_date, s.plant_id, round(capacity_kw, 3) AS plant_capacity_kw,
               round(generation, 3) AS expected_generation_kwh, round(peak, 3) AS expected_peak_power_kw, round(sun, 4) AS forecast_irradiance_kwh_m2,
               round(coalesce(ppa_rate_per_kwh, CAST(0.085 AS DOUBLE)), 4) AS ppa_rate_per_kwh, false AS maintenance_flag, 'v1' AS source_version
        FROM sites s JOIN (SELECT plant_id, sum(p) AS generation, max(p) AS peak, sum(sun) / 1000 AS sun FROM power GROUP BY 1) u ON u.plant_id = s.plant_id, day_list""",
    "scenario_range_join": """
        SELECT event_id, plant_id, inverter_id, event_time, scenario, round(power_factor, 6) AS power_factor
        FROM (SELECT *, (epoch_us(event_time) % 86400000000) / 1e6 AS sec FROM telem) e
        LEFT JOIN script w ON sec >= w_start AND sec < w_end AND (w_plant IS NULL OR w_plant = plant_id)
                          AND (w_inverter IS NULL OR w_inverter = inverter_id)""",
    "upsert_merge": """
        WITH newer AS (SELECT simulation_date + 7 AS simulation_date, plant_id, ppa_rate_per_kwh + 1 AS ppa_rate_per_kwh
                       FROM ref WHERE day(simulation_date) > 15)
        SELECT CAST(CAST(simulation_date AS DATE) AS VARCHAR) AS simulation_date, plant_id,
               round(coalesce(n.ppa_rate_per_kwh, r.ppa_rate_per_kwh), 6) AS ppa_rate_per_kwh
        FROM ref r FULL JOIN newer n USING (simulation_date, plant_id)""",
    "plant_reference": "SELECT plant_id, round(capacity_kw, 6) AS capacity_kw, configured_inverters FROM plant_ref",
    "portfolio_checks": """
        SELECT p.plant_id, CAST(NULL AS VARCHAR) AS inverter_id, 'warning' AS level, 'CAPACITY_MISMATCH' AS problem
        FROM sites p WHERE abs((SELECT sum(rated_power_kw) FROM fleet f WHERE f.plant_id = p.plant_id) / p.capacity_kw - 1) > 0.25""",
    "rated_capacity": """
        SELECT p.plant_id, round(p.capacity_kw, 6) AS capacity_kw, round(sum(rated_power_kw), 6) AS inverter_capacity_kw,
               count(*) AS inverter_count, round(sum(rated_power_kw) / p.capacity_kw, 6) AS capacity_ratio
        FROM sites p JOIN fleet f ON f.plant_id = p.plant_id GROUP BY p.plant_id, p.capacity_kw""",
    "installed_capacity": "SELECT round(sum(capacity_kw), 6) AS installed_capacity_kw FROM sites WHERE active",
    "portfolio_live": f"""
        SELECT window_end AS timestamp, (SELECT round(sum(capacity_kw), 6) FROM sites WHERE active) AS installed_capacity_kw,
               {_MEASURES}, {_fresh('window_end', 60)}
        FROM portfolio_rows ORDER BY window_end DESC LIMIT 1""",
    "plants_list": f"""
        SELECT p.plant_id, plant_name, round(capacity_kw, 6) AS capacity_kw, active,
               {_r('current_power_kw', 'performance_pct', 'availability_pct')},
               {_fresh('window_end', 21600)}, window_end AS last_update
        FROM sites p LEFT JOIN plant_rows m ON m.plant_id = p.plant_id""",
    "plant_live": f"""
        SELECT p.plant_id, plant_name, round(capacity_kw, 6) AS capacity_kw, window_end AS timestamp, {_MEASURES},
               {_fresh('window_end', 21600)}
        FROM sites p LEFT JOIN plant_rows m ON m.plant_id = p.plant_id""",
    "plant_live_one": f"""
        SELECT p.plant_id, plant_name, round(capacity_kw, 6) AS capacity_kw, window_end AS timestamp, {_MEASURES},
               {_fresh('window_end', 21600)}
        FROM sites p LEFT JOIN plant_rows m ON m.plant_id = p.plant_id WHERE p.plant_id = (SELECT min(plant_id) FROM sites)""",
    "plant_history_one": f"""
        SELECT plant_id, window_start, window_end, {_r('current_power_kw', 'avg_power_kw', 'expected_power_kw',
               'performance_pct', 'availability_pct')}
        FROM span_rows WHERE plant_id = (SELECT min(plant_id) FROM sites) AND window_end BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
    "plant_inverters_one": """
        SELECT plant_id, inverter_id, inverter_name, round(rated_power_kw, 6) AS rated_power_kw, active FROM fleet WHERE plant_id = (SELECT min(plant_id) FROM sites)""",
    "upsert_repeated": """
        SELECT CAST(CAST(simulation_date AS DATE) AS VARCHAR) AS simulation_date, plant_id,
               round(ppa_rate_per_kwh + CASE WHEN day(simulation_date) > 15 THEN CAST(0.5 AS DOUBLE) ELSE 0 END, 6) AS ppa_rate_per_kwh
        FROM ref""",
    "plant_ranking": f"""
        SELECT p.plant_id, {_r('performance_pct')} FROM sites p LEFT JOIN plant_rows m ON m.plant_id = p.plant_id""",
    "plant_history": f"""
        SELECT plant_id, window_start, window_end, {_r('current_power_kw', 'avg_power_kw', 'expected_power_kw',
               'performance_pct', 'availability_pct')}
        FROM span_rows WHERE window_end BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'""",
    "plant_inverters": """
        SELECT plant_id, inverter_id, inverter_name, round(rated_power_kw, 6) AS rated_power_kw, active FROM fleet""",
    "daily_totals": f"SELECT {_TOTALS} FROM totals",
    "daily_rollup": f"""
        SELECT CAST(CAST(simulation_date AS DATE) AS VARCHAR) AS simulation_date, plant_id, {_r('actual_generation_kwh', 'expected_generation_kwh',
               'lost_energy_kwh', 'actual_revenue', 'lost_revenue')}, row_count, alert_count, level,
               round(actual_generation_kwh / expected_generation_kwh * 100, 6) AS performance_pct
        FROM (SELECT simulation_date, plant_id, sum(actual_generation_kwh) AS actual_generation_kwh, sum(expected_generation_kwh) AS expected_generation_kwh,
                     sum(estimated_lost_energy_kwh) AS lost_energy_kwh, sum(estimated_actual_revenue) AS actual_revenue,
                     sum(estimated_lost_revenue) AS lost_revenue, count(*) AS row_count, CAST(sum(alert_count) AS BIGINT) AS alert_count,
                     CASE GROUPING_ID(simulation_date, plant_id) WHEN 0 THEN 'plant' WHEN 1 THEN 'day' ELSE 'all' END AS level
              FROM summary GROUP BY ROLLUP (simulation_date, plant_id))""",
    "daily_report_rows": f"""
        SELECT {_day()}, s.plant_id, plant_name, {_r('actual_generation_kwh', 'expected_generation_kwh',
               'performance_pct', 'availability_pct')}, round(estimated_lost_energy_kwh, 6) AS lost_energy_kwh,
               round(estimated_lost_revenue, 6) AS lost_revenue, alert_count, maintenance_flag
        FROM summary s JOIN sites p ON p.plant_id = s.plant_id""",
    "daily_report": f"""
        SELECT CAST(t.simulation_date AS VARCHAR) AS simulation_date, {_r('actual_generation_kwh',
               'expected_generation_kwh', 'lost_energy_kwh', 'actual_revenue', 'lost_revenue')}, plant_count,
               round(t.performance_pct, 6) AS performance_pct,
               b.plant_id AS best_plant_id, b.plant_name AS best_plant_name, round(b.performance_pct, 6) AS best_performance_pct,
               w.plant_id AS worst_plant_id, w.plant_name AS worst_plant_name, round(w.performance_pct, 6) AS worst_performance_pct
        FROM totals t
        LEFT JOIN ranked b ON b.simulation_date = t.simulation_date AND b.down = 1
        LEFT JOIN ranked w ON w.simulation_date = t.simulation_date AND w.up = 1""",
    "pipeline_health": """
        SELECT 'telemetry-stream' AS component, 'FAILED' AS status, max(ts) AS last_event_at,
               TIMESTAMP '2024-02-01' AS last_success_at, 'the batch raised' AS message FROM events""",
    "display_units": f"""
        SELECT plant_id, CASE WHEN expected_power_kw IS NULL THEN '—'
                              WHEN abs(expected_power_kw) >= 1000 THEN printf('%.2f MW', round(expected_power_kw / 1000, 2))
                              ELSE printf('%.1f kW', round(expected_power_kw, 1)) END AS expected,
               CASE WHEN sec < 60 THEN CAST(sec AS VARCHAR) || 's ago'
                    WHEN CAST(round(sec / CAST(60 AS DOUBLE)) AS BIGINT) < 60 THEN CAST(CAST(round(sec / CAST(60 AS DOUBLE)) AS BIGINT) AS VARCHAR) || 'm ago'
                    ELSE CAST(CAST(round(round(sec / CAST(60 AS DOUBLE)) / 60) AS BIGINT) AS VARCHAR) || 'h ago' END AS age,
               strftime(window_end, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST((epoch_us(window_end) % 1000000) // 1000 AS VARCHAR), 3, '0') || '+00' AS window_end_utc
        FROM (SELECT *, greatest(CAST(round((epoch_us({_AS_OF}) - epoch_us(window_end)) / 1e6) AS BIGINT), 0) AS sec FROM plant_rows)""",
}

_QUERIES["plant_metrics_with_silent"] = f"""
        SELECT {_PLANT_METRICS} FROM plant_rows
        UNION ALL
        SELECT plant_id, NULL, NULL, NULL, 0, 0, NULL, CASE WHEN configured_inverters > 0 THEN 0 END, NULL, NULL, 0,
               configured_inverters
        FROM plant_ref WHERE plant_id NOT IN (SELECT plant_id FROM telem)"""

_VIEWS["two_moments"] = """
        SELECT 1 AS m, max(event_time) AS moment FROM telem WHERE day(event_time) <= 15
        UNION ALL SELECT 2, max(event_time) FROM telem"""
_VIEWS["moment_states"] = """
        SELECT m, moment, i.plant_id, i.inverter_id, l.event_time, l.status, l.availability, l.irradiance_wm2 AS irr,
               l.active_power_kw AS power, i.rated_power_kw * least(coalesce(l.irradiance_wm2, 0) / 1000, 1) AS expected
        FROM in_service i CROSS JOIN two_moments
        LEFT JOIN (SELECT mm.m AS lm, t.* FROM telem t JOIN two_moments mm ON t.event_time <= mm.moment
                   QUALIFY row_number() OVER (PARTITION BY mm.m, plant_id, inverter_id
                                              ORDER BY event_time DESC, kafka_offset DESC) = 1) l
          ON l.lm = m AND l.plant_id = i.plant_id AND l.inverter_id = i.inverter_id"""
_VIEWS["moment_faults"] = """
        SELECT *, CASE WHEN alert_type = 'UNDERPERFORMANCE' THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
               CASE WHEN alert_type = 'TELEMETRY_GAP' THEN 0 ELSE greatest(expected - power, 0) END AS loss_kw,
               CASE alert_type
                   WHEN 'TELEMETRY_GAP' THEN 'No telemetry received from inverter ' || inverter_id || ' at plant ' || plant_id
                   WHEN 'INVERTER_OFFLINE' THEN 'Inverter ' || inverter_id || ' at plant ' || plant_id || ' reported OFFLINE'
                   ELSE 'Inverter ' || inverter_id || ' at plant ' || plant_id || ' generating '
                        || CAST(round(power / expected * 100, 1) AS VARCHAR) || '% of expected under current irradiance' END AS message
        FROM (SELECT *, CASE WHEN event_time IS NULL THEN 'TELEMETRY_GAP'
                             WHEN status = 'OFFLINE' OR availability = 0 THEN 'INVERTER_OFFLINE'
                             WHEN irr >= 150 AND power / expected * 100 < 80 THEN 'UNDERPERFORMANCE' END AS alert_type
              FROM moment_states) WHERE alert_type IS NOT NULL"""
_QUERIES["lifecycle_step"] = f"""
        SELECT plant_id, inverter_id, alert_type, arg_max(severity, m) AS severity, arg_max(message, m) AS message,
               min(moment) AS first_observed_at, max(moment) AS last_observed_at, count(*) AS observation_count,
               round(sum(loss_kw), 6) AS sum_loss_kw,
               CASE WHEN max(m) = 1 THEN (SELECT max(moment) FROM two_moments) END AS ended_at
        FROM moment_faults GROUP BY 1, 2, 3"""


# --- streams: the same figures over the records that survive validation ---------

def _over(view: str, **renamed: str) -> str:
    """A view's text with other views put in the place of those it reads."""
    text = _VIEWS[view]
    for old, new in renamed.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return text


_VIEWS["spans_in"] = _over("span_events_6", telem="trusted")
_VIEWS["spans_out"] = _over("span_rows", span_events_6="spans_in")
_QUERIES["stream_valid"] = f"""
        SELECT event_id, plant_id, inverter_id, {_r('active_power_kw', 'energy_today_kwh', 'irradiance_wm2')}, status, {_r('availability')}, event_time
        FROM trusted"""
# A window is written once event time has passed its end by the watermark.
_QUERIES["stream_windowed_metrics"] = f"""
        SELECT {_PLANT_METRICS} FROM spans_out
        WHERE window_end <= (SELECT max(event_time) FROM trusted) - INTERVAL 2 MINUTE"""
_VIEWS["slides_in"] = _over("span_events_3", telem="trusted")
_VIEWS["slides_out"] = _over("slide_rows", span_events_3="slides_in")
_QUERIES["stream_sliding_metrics"] = f"""
        SELECT {_PLANT_METRICS} FROM slides_out
        WHERE window_end <= (SELECT max(event_time) FROM trusted) - INTERVAL 2 MINUTE"""
_QUERIES["stream_quarantine_rate"] = f"""
        SELECT * FROM ({_QUERIES["quarantine_rate"]})
        WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(kafka_timestamp) FROM judged WHERE rejection_reason IS NOT NULL) - INTERVAL 2 MINUTE"""
_QUERIES["upsert_by_file"] = _QUERIES["upsert_merge"]
_QUERIES["report_export"] = _QUERIES["daily_report_rows"]
_QUERIES["portfolio_flatten"] = """
        SELECT f.plant_id, plant_name, inverter_id, inverter_name, round(rated_power_kw, 6) AS rated_power_kw, true AS active
        FROM fleet f JOIN sites p ON p.plant_id = f.plant_id"""
_QUERIES["stream_quarantine"] = _QUERIES["quarantine_counts"]

_VIEWS["kept"] = "SELECT * REPLACE (CAST(event_time AS DATE) AS simulation_date) FROM (SELECT *, NULL AS simulation_date FROM trusted)"
_VIEWS["kept_increments"] = _over("increments", telem="kept")
_VIEWS["kept_per_inverter"] = _over("per_inverter", increments="kept_increments")
_VIEWS["kept_actuals"] = _over("actuals", per_inverter="kept_per_inverter")
_QUERIES["stream_archive_roundtrip"] = _QUERIES["plant_actuals"].replace("FROM actuals", "FROM kept_actuals")

_QUERIES["archive_compacted"] = _QUERIES["stream_archive_roundtrip"]

_VIEWS["week_events"] = """
        SELECT * REPLACE (epoch_us(event_time) // 604800000000 AS simulation_date)
        FROM (SELECT *, NULL AS simulation_date FROM trusted)"""
_VIEWS["week_ticks"] = """
        SELECT simulation_date AS frame, max(event_time) AS observed_at,
               row_number() OVER (ORDER BY simulation_date) AS tick FROM week_events GROUP BY 1"""
_VIEWS["week_states"] = _over("states", ticks="week_ticks", telem="week_events")
_VIEWS["week_diagnosed"] = _over("diagnosed", states="week_states")
_VIEWS["week_faults"] = _over("faults", diagnosed="week_diagnosed")
_VIEWS["week_runs"] = _over("runs", ticks="week_ticks", faults="week_faults")
_VIEWS["week_alerts"] = _over("alert_rows", runs="week_runs")
_QUERIES["stream_alert_lifecycle"] = f"SELECT {_ALERT} FROM week_alerts"

_QUERIES["stream_conditions"] = """
        SELECT plant_id, inverter_id, alert_type, severity, first_observed_at, last_observed_at, observation_count, CAST(0 AS BIGINT) AS keys_twice
        FROM week_runs WHERE ended_at IS NULL"""
_QUERIES["stream_speed_layer"] = """
        SELECT 'live' AS sink, count(DISTINCT plant_id) AS row_count FROM trusted
        UNION ALL SELECT 'archive', count(*) FROM judged WHERE rejection_reason IS NULL
        UNION ALL SELECT 'quarantine', count(*) FROM judged WHERE rejection_reason IS NOT NULL"""
# The last week was never committed.
_VIEWS["known_events"] = "SELECT * FROM week_events WHERE simulation_date < (SELECT max(simulation_date) FROM week_events)"
for _view, _read in (("ticks", {"week_events": "known_events"}), ("states", {"week_ticks": "known_ticks", "week_events": "known_events"}),
                     ("diagnosed", {"week_states": "known_states"}), ("faults", {"week_diagnosed": "known_diagnosed"}),
                     ("runs", {"week_ticks": "known_ticks", "week_faults": "known_faults"}), ("alerts", {"week_runs": "known_runs"})):
    _VIEWS[f"known_{_view}"] = _over(f"week_{_view}", **_read)
_QUERIES["stream_live_crash"] = f"""
        SELECT {_ALERT}, (SELECT count(*) FROM week_plant_rows WHERE week < (SELECT max(simulation_date) FROM week_events)) AS plant_rows,
               (SELECT count(DISTINCT simulation_date) FROM known_events) AS portfolio_rows, 'FAILED' AS health
        FROM known_alerts"""

# The live tables: a microbatch is a week, and speaks for the events it brought.
_VIEWS["week_latest"] = """
        SELECT * FROM week_events QUALIFY row_number() OVER (
            PARTITION BY plant_id, inverter_id, simulation_date ORDER BY event_time DESC, kafka_offset DESC) = 1"""
_VIEWS["week_live"] = """
        SELECT cur.plant_id, b.window_start, b.window_end, current_power_kw, avg_power_kw,
               CASE WHEN irr >= 150 THEN capacity_kw * least(irr / 1000, 1) END AS expected_power_kw, irr AS avg_irradiance_wm2,
               online / nullif(CAST(coalesce(configured_inverters, reporting) AS DOUBLE), 0) * 100 AS availability_pct,
               online AS online_inverters, greatest(coalesce(configured_inverters, reporting) - online, 0) AS offline_inverters, cur.simulation_date AS week
        FROM (SELECT plant_id, simulation_date, sum(active_power_kw) AS current_power_kw, avg(irradiance_wm2) AS irr,
                     count(*) FILTER (status <> 'OFFLINE' AND availability > 0) AS online, count(*) AS reporting FROM week_latest GROUP BY 1, 2) cur
        JOIN (SELECT plant_id, simulation_date, min(event_time) AS window_start, max(event_time) AS window_end FROM week_events GROUP BY 1, 2) b
          ON b.plant_id = cur.plant_id AND b.simulation_date = cur.simulation_date
        JOIN (SELECT plant_id, simulation_date, avg(p) AS avg_power_kw
              FROM (SELECT plant_id, simulation_date, event_time, sum(active_power_kw) AS p FROM week_events GROUP BY 1, 2, 3) GROUP BY 1, 2) a
          ON a.plant_id = cur.plant_id AND a.simulation_date = cur.simulation_date
        LEFT JOIN plant_ref r ON r.plant_id = cur.plant_id"""
_VIEWS["week_plant_rows"] = """
        SELECT *, CASE WHEN expected_power_kw > 0 THEN current_power_kw / expected_power_kw * 100 END AS performance_pct,
               CASE WHEN expected_power_kw IS NOT NULL THEN greatest(expected_power_kw - current_power_kw, 0) END AS estimated_loss_kw
        FROM week_live"""
_QUERIES["stream_live_metrics"] = f"SELECT {_PLANT_METRICS} FROM week_plant_rows"
_QUERIES["stream_live_portfolio"] = f"""
        SELECT min(window_start) AS window_start, max(window_end) AS window_end, round(sum(current_power_kw), 6) AS current_power_kw,
               CAST(sum(online_inverters) AS BIGINT) AS online_inverters, CAST(sum(offline_inverters) AS BIGINT) AS offline_inverters,
               round(sum(estimated_loss_kw), 6) AS estimated_loss_kw
        FROM week_plant_rows GROUP BY week"""
_QUERIES["stream_live_health"] = """
        SELECT 'telemetry-stream' AS component, 'DEGRADED' AS status, max(event_time) AS last_event_at,
               'no telemetry in this microbatch' AS message FROM week_events"""

# Event-time silence: readings of six-hour windows that were released, and between them silent instants every
# three days. A window is released, and silence certain, once the watermark has passed.
_VIEWS["heard"] = """
        SELECT t.plant_id, t.inverter_id, epoch_us(t.event_time) // 1000 AS heard_at, t.active_power_kw AS power, t.irradiance_wm2 AS irr,
               t.status, t.availability, f.rated_power_kw * least(t.irradiance_wm2 / 1000, 1) AS expected
        FROM (SELECT * FROM trusted
              QUALIFY row_number() OVER (PARTITION BY plant_id, inverter_id, epoch_us(event_time) // 21600000000
                                         ORDER BY event_time DESC, kafka_offset DESC) = 1) t
        JOIN in_service f ON f.plant_id = t.plant_id AND f.inverter_id = t.inverter_id
        WHERE (epoch_us(event_time) // 21600000000 + 1) * 21600000 <= (SELECT mark FROM stream_mark)"""
_VIEWS["stream_mark"] = "SELECT epoch_us(max(event_time)) // 1000 - 120000 AS mark FROM trusted"
_VIEWS["heard_faults"] = """
        SELECT plant_id, inverter_id, heard_at, alert_type,
               CASE WHEN alert_type = 'UNDERPERFORMANCE' THEN 'WARNING' WHEN alert_type IS NOT NULL THEN 'CRITICAL' END AS severity,
               CASE WHEN alert_type = 'INVERTER_OFFLINE' THEN 'Inverter ' || inverter_id || ' at plant ' || plant_id || ' reported OFFLINE'
                    WHEN alert_type IS NOT NULL THEN 'Inverter ' || inverter_id || ' at plant ' || plant_id || ' generating '
                         || CAST(round(power / expected * 100, 1) AS VARCHAR) || '% of expected under current irradiance' END AS message,
               greatest(expected - power, 0) AS loss_kw
        FROM (SELECT *, CASE WHEN status = 'OFFLINE' OR availability = 0 THEN 'INVERTER_OFFLINE'
                             WHEN irr >= 150 AND power / expected * 100 < 80 THEN 'UNDERPERFORMANCE' END AS alert_type FROM heard)
        UNION ALL
        SELECT plant_id, inverter_id, epoch_ms(TIMESTAMP '2024-01-01'), NULL, NULL, NULL, 0 FROM in_service"""
_VIEWS["silence_story"] = """
        SELECT plant_id, inverter_id, heard_at AS from_at, heard_at AS to_at, 1 AS n, alert_type, severity, message, loss_kw FROM heard_faults
        UNION ALL
        SELECT plant_id, inverter_id, heard_at + 259200000, heard_at + n * 259200000, n, 'TELEMETRY_GAP', 'CRITICAL',
               'No telemetry received from inverter ' || inverter_id || ' at plant ' || plant_id, 0
        FROM (SELECT *, (coalesce(lead(heard_at) OVER (PARTITION BY plant_id, inverter_id ORDER BY heard_at) - 1,
                                  (SELECT mark FROM stream_mark) - 21600000) - heard_at) // 259200000 AS n FROM heard_faults)
        WHERE n > 0"""
_VIEWS["silence_runs"] = """
        SELECT *, min(from_at) OVER run AS first_at, max(to_at) OVER run AS final_at,
               sum(n) OVER upto AS seen, sum(loss_kw) OVER upto AS lost, sum(n) OVER run AS run_n, sum(loss_kw) OVER run AS run_loss,
               max(follows) OVER run AS clear_at, row_number() OVER (PARTITION BY plant_id, inverter_id, island ORDER BY from_at DESC) AS back
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY plant_id, inverter_id ORDER BY from_at) AS island,
                     lead(from_at) OVER (PARTITION BY plant_id, inverter_id ORDER BY from_at) AS follows
              FROM (SELECT *, CASE WHEN alert_type IS NOT DISTINCT FROM lag(alert_type) OVER (PARTITION BY plant_id, inverter_id ORDER BY from_at)
                                   THEN 0 ELSE 1 END AS fresh FROM silence_story))
        WINDOW run AS (PARTITION BY plant_id, inverter_id, island),
               upto AS (PARTITION BY plant_id, inverter_id, island ORDER BY from_at)"""
# The observation at which a run has lasted an hour: a reading, or an instant inside a silence.
_VIEWS["silence_steps"] = """
        SELECT *, CASE WHEN to_at - first_at >= 3600000
                       THEN greatest(0, CAST(ceil((first_at + 3600000 - from_at) / CAST(259200000 AS DOUBLE)) AS BIGINT)) END AS opens_after,
               coalesce(lag(to_at) OVER (PARTITION BY plant_id, inverter_id, island ORDER BY from_at) - first_at >= 3600000, false) AS was_open
        FROM silence_runs WHERE alert_type IS NOT NULL"""
_SILENCE = """plant_id, inverter_id, {change} AS change, alert_type, severity, message, make_timestamp(CAST(first_at * 1000 AS BIGINT)) AS first_observed_at,
               make_timestamp(CAST(({last}) * 1000 AS BIGINT)) AS last_observed_at, CAST({n} AS BIGINT) AS observation_count,
               round({loss}, 6) AS sum_loss_kw, {ended} AS ended_at"""
_QUERIES["stream_silence"] = f"""
        SELECT {_SILENCE.format(change="CASE WHEN was_open THEN 'REFRESHED' ELSE 'OPENED' END", last="CASE WHEN was_open THEN to_at ELSE from_at + opens_after * 259200000 END",
                                n="CASE WHEN was_open THEN seen ELSE seen - n + opens_after + 1 END", loss="lost", ended="CAST(NULL AS TIMESTAMP)")}
        FROM silence_steps WHERE opens_after IS NOT NULL AND (NOT was_open OR alert_type <> 'TELEMETRY_GAP')
        UNION ALL
        SELECT {_SILENCE.format(change="'RESOLVED'", last="final_at", n="run_n", loss="run_loss", ended="make_timestamp(CAST(clear_at * 1000 AS BIGINT))")}
        FROM (SELECT *, max(follows) OVER (PARTITION BY plant_id, inverter_id, island) AS after FROM silence_runs)
        WHERE back = 1 AND alert_type IS NOT NULL AND follows IS NOT NULL AND final_at - first_at >= 3600000"""

_QUERIES["stream_state"] = """
        SELECT plant_id, inverter_id, alert_type, severity, make_timestamp(CAST(first_at * 1000 AS BIGINT)) AS first_observed_at,
               make_timestamp(CAST(final_at * 1000 AS BIGINT)) AS last_observed_at, CAST(run_n AS BIGINT) AS observation_count,
               round(run_loss, 6) AS sum_loss_kw, final_at - first_at >= 3600000 AS opened, CAST(0 AS BIGINT) AS keys_twice
        FROM silence_runs WHERE back = 1 AND alert_type IS NOT NULL AND follows IS NULL"""

# The feed lacks a region's plants on the 13th, so that day is refused, as is any day with an
# implausible plant; plants out of service are in no active portfolio.
_VIEWS["job_rows"] = _over("recon_base", actuals="kept_actuals")
_QUERIES["daily_job"] = f"""
        SELECT {_TOTALS}
        FROM (SELECT simulation_date, sum(actual_generation_kwh) AS actual_generation_kwh,
                     sum(expected_generation_kwh) AS expected_generation_kwh,
                     sum(estimated_lost_energy_kwh) AS lost_energy_kwh,
                     sum(actual_generation_kwh * ppa_rate_per_kwh) AS actual_revenue,
                     sum(estimated_lost_energy_kwh * ppa_rate_per_kwh) AS lost_revenue, count(*) AS plant_count,
                     sum(actual_generation_kwh) / sum(expected_generation_kwh) * 100 AS performance_pct
              FROM job_rows GROUP BY 1
              HAVING max(performance_pct) <= 300 AND day(simulation_date) <> 13)"""

for _view, _read in (("ticks", {"telem": "kept"}), ("states", {"ticks": "kept_ticks", "telem": "kept"}), ("diagnosed", {"states": "kept_states"}),
                     ("faults", {"diagnosed": "kept_diagnosed"}), ("runs", {"ticks": "kept_ticks", "faults": "kept_faults"}),
                     ("alert_rows", {"runs": "kept_runs"}), ("alerts_per_day", {"alert_rows": "kept_alert_rows"})):
    _VIEWS[f"kept_{_view}"] = _over(_view, **_read)
_VIEWS["job_recon"] = _over("recon", recon_base="job_rows", alerts_per_day="kept_alerts_per_day")
_QUERIES["daily_job_rerun"] = f"""
        SELECT *, CAST(simulation_date AS DATE) = (SELECT min(CAST(event_time AS DATE)) FROM telem) + 4 AS reran FROM ({_QUERIES["daily_job"]})"""
_QUERIES["feed_files"] = """
        SELECT CAST(CAST(simulation_date AS DATE) AS VARCHAR) AS feed_date, row_number() OVER (PARTITION BY simulation_date ORDER BY plant_id) AS position, plant_id,
               CAST(plant_capacity_kw AS VARCHAR) AS plant_capacity_kw, CAST(expected_generation_kwh AS VARCHAR) AS expected_generation_kwh,
               CAST(expected_peak_power_kw AS VARCHAR) AS expected_peak_power_kw, CAST(forecast_irradiance_kwh_m2 AS VARCHAR) AS forecast_irradiance_kwh_m2,
               CAST(ppa_rate_per_kwh AS VARCHAR) AS ppa_rate_per_kwh, CAST(maintenance_flag AS VARCHAR) AS maintenance_flag, source_version,
               CASE WHEN day(simulation_date) % 3 = 0 THEN 'warning' END AS level, CASE WHEN day(simulation_date) % 3 = 0 THEN 'note_' || day(simulation_date) END AS detail
        FROM ref"""
_QUERIES["daily_job_issues"] = """
        SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS simulation_date, 'feed' AS stage, p.plant_id, 'PLANT_NOT_IN_FEED' AS problem
        FROM sites p, day_list WHERE p.n_regionkey = 2 AND day(d) = 13
        UNION ALL
        SELECT CAST(CAST(simulation_date AS DATE) AS VARCHAR), 'reconcile', plant_id, 'IMPLAUSIBLE_PERFORMANCE'
        FROM job_rows WHERE performance_pct > 300 AND day(simulation_date) <> 13"""
_QUERIES["daily_job_summary"] = f"""
        SELECT {_SUMMARY} FROM job_recon r
        WHERE day(simulation_date) <> 13
          AND NOT EXISTS (SELECT 1 FROM job_rows j WHERE j.simulation_date = r.simulation_date AND j.performance_pct > 300)"""


def _needed(text: str, found: set[str]) -> set[str]:
    for name in _VIEWS:
        if name not in found and re.search(rf"\b{name}\b", text):
            found.add(name)
            _needed(_VIEWS[name], found)
    return found


def _expand(text: str) -> str:
    body = text.strip()
    names = _needed(body, set())
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for dep in _VIEWS:
            if dep != name and re.search(rf"\b{dep}\b", _VIEWS[name]):
                place(dep)
        ordered.append(name)

    for name in names:
        place(name)
    parts = [f"{n} AS ({_VIEWS[n].strip()})" for n in ordered]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*parts, body[5:]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def oracle_sql() -> dict[str, str]:
    return {name: _expand(text) for name, text in _QUERIES.items()}
