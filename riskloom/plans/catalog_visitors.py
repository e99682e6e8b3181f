"""Traffic queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions import web
from riskloom.operators import visitors as vs
from riskloom.plans.catalog import Catalog
from riskloom.plans.oracle_views import pct
from riskloom.plans.testbed import AGENTS, Testbed
from riskloom.session import materialize

VIEW_SQL = "NOT starts_with(path, '/api/') AND NOT starts_with(path, '/static') AND path <> '/health'"

MASK_SQL = """CASE WHEN ip_address IS NULL OR ip_address = '' THEN NULL
    WHEN len(string_split(ip_address, '.')) = 4 THEN regexp_replace(ip_address, '[^.]*$', 'xxx') ELSE 'xxx.xxx.xxx.xxx' END"""

ISO_US = """CASE WHEN {0} = date_trunc('second', {0}) THEN strftime({0}, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END"""

DIMENSIONS_SQL = """
    SELECT 'browser' AS dimension, coalesce(browser, 'Unknown') AS name, count(*) AS n_visits FROM {0} GROUP BY browser
    UNION ALL SELECT 'device', coalesce(device_type, 'Unknown'), count(*) FROM {0} GROUP BY device_type
    UNION ALL SELECT 'os', coalesce(os, 'Unknown'), count(*) FROM {0} GROUP BY os"""

CLIENT_IP_SQL = "CASE WHEN forwarded LIKE '%,%' THEN trim(split_part(forwarded, ',', 1)) ELSE coalesce(forwarded, peer) END"

# what the fixture's agents are, by k % 5: desktop Chrome, an iPhone's own browser, Firefox, Edge on a telephone
BROWSER_SQL = "CASE k5 WHEN 1 THEN 'Chrome' WHEN 2 THEN 'Mobile Safari' WHEN 3 THEN 'Firefox' WHEN 4 THEN 'Edge' ELSE 'Other' END"
DEVICE_SQL = "CASE k5 WHEN 2 THEN 'iPhone' WHEN 4 THEN 'Generic Smartphone' ELSE 'Other' END"
SYSTEM_SQL = "CASE k5 WHEN 1 THEN 'Windows' WHEN 2 THEN 'iOS' WHEN 3 THEN 'Linux' WHEN 4 THEN 'Android' ELSE 'Other' END"
AGENT_NO_SQL = "CASE user_agent " + " ".join(f"WHEN '{a}' THEN {i + 1}" for i, a in enumerate(AGENTS)) + " ELSE 0 END"

INGEST_SQL = f"""
    SELECT id, {CLIENT_IP_SQL} AS ip_address, coalesce(user_agent, '') AS user_agent, path, method,
           {BROWSER_SQL} AS browser, {DEVICE_SQL} AS device_type, {SYSTEM_SQL} AS os,
           {ISO_US.format('ts')} AS timestamp, false AS led_to_analysis
    FROM (SELECT *, {AGENT_NO_SQL} AS k5 FROM requests) WHERE {VIEW_SQL}"""

SESSIONS_SQL = """
    SELECT ip_address, session_no, {iso_from} AS started_at, {iso_to} AS ended_at, n_visits FROM (
      SELECT ip_address, CAST(no AS BIGINT) AS session_no, min(ts) AS a, max(ts) AS z, count(*) AS n_visits FROM (
        SELECT *, sum(opens) OVER (PARTITION BY ip_address ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS no FROM (
          SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ip_address ORDER BY ts, id) < INTERVAL 30 MINUTE
                         THEN 0 ELSE 1 END AS opens FROM visitors)) GROUP BY 1, 2)""".format(
    iso_from=ISO_US.format("a"), iso_to=ISO_US.format("z"))


def iso(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, tx.iso_timestamp(F.col(c)))
    return df


def last_week(bed: Testbed) -> DataFrame:
    return vs.trailing(bed.visitors, bed.asof, 7)


def _bars(bed: Testbed) -> DataFrame:
    return vs.bars(vs.breakdowns(last_week(bed)))


def _marked(bed: Testbed) -> DataFrame:
    analyses = bed.visitors.where(F.col("path") == "/purchase").select("ip_address", "timestamp")
    return vs.mark_analyses(vs.page_views(bed.visitors), analyses).select("id", "led_to_analysis")


SKETCH_DAYS = (1, 3, 7, 14, 30)


def _sketched(bed: Testbed) -> DataFrame:
    """Addresses of several windows of whole days from one stored table of daily sketches, held against exact counts."""
    sketches = materialize(vs.daily_sketches(bed.visitors), "sketches")
    last = sketches.agg(F.max("day")).scalar()
    rows = None
    for days in SKETCH_DAYS:
        first = F.date_format(F.date_sub(F.to_date(last), days - 1), "yyyy-MM-dd")
        exact = vs.totals(bed.visitors.where(F.date_format("timestamp", "yyyy-MM-dd") >= first)).select(F.col("unique_ips").alias("exact"))
        row = vs.totals_between(sketches, first, last).select(
            F.lit(days).alias("days"), "total_visitors", (F.abs(F.col("unique_ips") / exact.scalar() - 1) <= 0.03).alias("within_3_percent"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def register(c: Catalog) -> None:
    c.add("v01_page_views", lambda b: vs.page_views(b.visitors).select("id", "path"),
          f"SELECT id, path FROM visitors WHERE {VIEW_SQL}")
    c.add("v02_client_ip", lambda b: b.requests.select(
        "id", web.client_ip(F.col("forwarded"), F.col("peer")).alias("ip_address")),
        f"SELECT id, {CLIENT_IP_SQL} AS ip_address FROM requests")
    c.add("v03_agent_families", lambda b: b.requests.select(
        "id", web.family(F.col("user_agent"), web.BROWSER_RULES).alias("browser"),
        web.family(F.col("user_agent"), web.DEVICE_RULES).alias("device_type"),
        web.family(F.col("user_agent"), web.OS_RULES).alias("os")), f"""
        SELECT id, {BROWSER_SQL} AS browser, {DEVICE_SQL} AS device_type, {SYSTEM_SQL} AS os
        FROM (SELECT *, {AGENT_NO_SQL} AS k5 FROM requests)""")
    c.add("v04_anonymize_ip", lambda b: b.visitors.select(
        "id", web.anonymize_ip(F.when(F.col("id") % 10 == 0, F.lit("::1")).otherwise(F.col("ip_address"))).alias("ip_address")),
        f"SELECT id, {MASK_SQL} AS ip_address FROM (SELECT id, CASE WHEN id % 10 = 0 THEN '::1' ELSE ip_address END AS ip_address FROM visitors)")
    c.add("v05_trailing_total", lambda b: last_week(b).agg(F.count("*").alias("total_visitors")),
          "SELECT count(*) AS total_visitors FROM last_week")
    c.add("v06_unique_ips", lambda b: vs.totals(last_week(b)),
          "SELECT count(*) AS total_visitors, count(DISTINCT ip_address) AS unique_ips FROM last_week")
    c.add("v06_unique_ips_approximate", lambda b: vs.approximate_totals(last_week(b)))
    c.add("v06_unique_ips_sketched", _sketched, f"""
        SELECT CAST(d AS INTEGER) AS days, count(*) AS total_visitors, true AS within_3_percent
        FROM visitors, (SELECT unnest([{', '.join(map(str, SKETCH_DAYS))}]) AS d)
        WHERE date_trunc('day', ts) > date_trunc('day', (SELECT max(ts) FROM events)) - to_days(CAST(d AS INTEGER)) GROUP BY d""")
    c.add("v07_top_paths", lambda b: vs.top_paths(last_week(b)),
          "SELECT path, count(*) AS n_visits FROM last_week GROUP BY path ORDER BY n_visits DESC, path LIMIT 10")
    c.add("v08_breakdowns", lambda b: vs.breakdowns(last_week(b)), DIMENSIONS_SQL.format("last_week"))
    c.add("v09_daily_visits", lambda b: vs.daily(last_week(b)),
          "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_visits FROM last_week GROUP BY 1")
    c.add("v10_headline", lambda b: vs.headline(last_week(b), 7), """
        SELECT count(*) AS total_visitors,
               (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM last_week GROUP BY path
                ORDER BY n DESC, path LIMIT 10)) AS page_views,
               CAST(floor(count(*) / 7 + 0.5) AS BIGINT) AS avg_daily FROM last_week""")
    c.add("v11_bars", _bars, f"""
        SELECT dimension, name, n_visits, CAST(r AS INTEGER) AS rank, {pct('n_visits', 'peak')} AS width FROM (
          SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n_visits DESC, name) AS r,
                 max(n_visits) OVER (PARTITION BY dimension) AS peak FROM ({DIMENSIONS_SQL.format('last_week')})) WHERE r <= 5""")
    c.add("v12_recent_visitors", lambda b: iso(vs.recent(b.visitors), "timestamp"), f"""
        SELECT id, {MASK_SQL} AS ip_address, path, method, browser, device_type, os, {ISO_US.format('ts')} AS timestamp,
               false AS led_to_analysis FROM visitors ORDER BY ts DESC, id DESC LIMIT 50""")
    c.add("v13_retention", lambda b: vs.keep_recent(b.visitors, b.asof, 20).select("id", "path"), """
        SELECT id, path FROM visitors WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY""")
    c.add("v14_led_to_analysis", _marked, f"""
        SELECT v.id, EXISTS (SELECT 1 FROM visitors a WHERE a.path = '/purchase' AND a.ip_address = v.ip_address
                             AND a.ts >= v.ts AND a.ts <= v.ts + INTERVAL 30 MINUTE) AS led_to_analysis
        FROM visitors v WHERE {VIEW_SQL}""")
    c.add("t08_sessions", lambda b: iso(vs.sessions(b.visitors), "started_at", "ended_at"), SESSIONS_SQL)
