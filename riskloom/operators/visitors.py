"""Site traffic: ingest of page views, breakdowns, retention, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import rates, web

TOP_PATHS, BARS, RECENT, KEEP_DAYS = 10, 5, 50, 30
SESSION_GAP_MINUTES = 30


def page_views(requests: DataFrame) -> DataFrame:
    return requests.where(web.is_page_view(F.col("path")))


def ingest(requests: DataFrame) -> DataFrame:
    """Visitor rows from raw requests (``forwarded, peer, user_agent, path, method, timestamp``)."""
    agent = F.coalesce("user_agent", F.lit(""))
    return page_views(requests).select(
        "id",
        web.client_ip(F.col("forwarded"), F.col("peer")).alias("ip_address"),
        F.substring(agent, 1, web.USER_AGENT_LIMIT).alias("user_agent"),
        "path", "method",
        web.family(agent, web.BROWSER_RULES).alias("browser"),
        web.family(agent, web.DEVICE_RULES).alias("device_type"),
        web.family(agent, web.OS_RULES).alias("os"),
        "timestamp",
        F.lit(False).alias("led_to_analysis"),
    )


def trailing(visits: DataFrame, asof: Column, days: int = 7) -> DataFrame:
    """Visits of the last ``days`` days before ``asof`` (a literal or a scalar subquery)."""
    return visits.where(F.col("timestamp") >= asof - F.make_dt_interval(days=F.lit(days)))


def totals(visits: DataFrame) -> DataFrame:
    return visits.agg(F.count("*").alias("total_visitors"), F.countDistinct("ip_address").alias("unique_ips"))


def approximate_totals(visits: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Bounded-state variant, for streams and very many addresses."""
    return visits.agg(
        F.count("*").alias("total_visitors"), F.approx_count_distinct("ip_address", rsd).alias("unique_ips"))


#: Registers of a daily sketch, as a power of two: a standard error of about 0.8 %, 16 kB a day at most.
SKETCH_LOG = 14


def daily_sketches(visits: DataFrame) -> DataFrame:
    """``day, n_visits, addresses``: a mergeable sketch of each day's addresses, meant to be stored once per day."""
    return visits.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n_visits"), F.hll_sketch_agg("ip_address", SKETCH_LOG).alias("addresses"))


def totals_between(sketches: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """Visits and estimated addresses of any stretch of whole days, from the stored sketches alone."""
    chosen = sketches.where((F.col("day") >= first_day) & (F.col("day") <= last_day))
    return chosen.agg(F.coalesce(F.sum("n_visits"), F.lit(0)).alias("total_visitors"),
                      F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("addresses")), F.lit(0)).alias("unique_ips"))


def top_paths(visits: DataFrame, limit: int = TOP_PATHS) -> DataFrame:
    return visits.groupBy("path").agg(F.count("*").alias("n_visits")).orderBy(F.desc("n_visits"), "path").limit(limit)


def breakdowns(visits: DataFrame) -> DataFrame:
    """Visits per browser, device and system in one pass; null is its own group, shown as Unknown."""
    grouped = visits.groupingSets(
        [["browser"], ["device_type"], ["os"]], "browser", "device_type", "os"
    ).agg(F.grouping_id().alias("_g"), F.count("*").alias("n_visits"))
    dimension = F.when(F.col("_g") == 3, "browser").when(F.col("_g") == 5, "device").otherwise("os")
    name = F.when(F.col("_g") == 3, F.col("browser")).when(F.col("_g") == 5, F.col("device_type")).otherwise(F.col("os"))
    return grouped.select(dimension.alias("dimension"), web.or_unknown(name).alias("name"), "n_visits")


def daily(visits: DataFrame) -> DataFrame:
    return visits.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_visits"))


def headline(visits: DataFrame, days: int = 7) -> DataFrame:
    """Page-view total over the top paths only, and rounded visits per day."""
    shown = top_paths(visits).agg(F.coalesce(F.sum("n_visits"), F.lit(0))).scalar()
    return visits.agg(F.count("*").alias("total_visitors")).select(
        "total_visitors", shown.alias("page_views"),
        F.when(F.col("total_visitors") > 0, F.floor(F.col("total_visitors") / days + 0.5))
        .otherwise(0).cast("long").alias("avg_daily"),
    )


def bars(counts: DataFrame, by: str = "dimension", name: str = "name", limit: int = BARS) -> DataFrame:
    """First ``limit`` bars per dimension; width is relative to the largest of the whole list."""
    order = Window.partitionBy(by).orderBy(F.desc("n_visits"), name)
    peak = counts.groupBy(by).agg(F.max("n_visits").alias("_peak"))
    first = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return first.join(peak, by).select(
        by, name, "n_visits", "rank", rates.percent(F.col("n_visits"), F.col("_peak")).alias("width"))


def recent(visits: DataFrame, limit: int = RECENT) -> DataFrame:
    """Newest visits with masked addresses; the mask is applied after the cut."""
    return visits.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).select(
        "id", web.anonymize_ip(F.col("ip_address")).alias("ip_address"), "path", "method", "browser",
        "device_type", "os", "timestamp", "led_to_analysis")


def keep_recent(visits: DataFrame, asof: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Rows that retention keeps.  On a date-partitioned table the filter prunes whole partitions."""
    return visits.where(F.col("timestamp") >= asof - F.make_dt_interval(days=F.lit(days)))


def mark_analyses(visits: DataFrame, analyses: DataFrame, minutes: int = 30) -> DataFrame:
    """Set ``led_to_analysis`` where the same address ran an analysis within ``minutes``.

    Analyses are reduced to their first and last time per address and time slot
    and visits look at their own slot and the next, so the work is an
    equi-join that holds for an address with any share of the rows.
    """
    width = minutes * 60
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = lambda us: F.floor(us / F.lit(width * 1_000_000)).cast("long")
    marks = analyses.select("ip_address", seconds("timestamp").alias("_a")).groupBy(
        "ip_address", slot(F.col("_a")).alias("_slot")
    ).agg(F.min("_a").alias("_first"), F.max("_a").alias("_last"))
    base = visits.withColumn("_v", seconds("timestamp")).withColumn("_slot", slot(F.col("_v")))
    own = marks.select("ip_address", "_slot", F.col("_last").alias("_own_last"))
    following = marks.select("ip_address", (F.col("_slot") - 1).alias("_slot"), F.col("_first").alias("_next_first"))
    slots = own.join(following, ["ip_address", "_slot"], "full")
    hit = (F.col("_own_last") >= F.col("_v")) | (F.col("_next_first") <= F.col("_v") + width * 1_000_000)
    return base.join(slots, ["ip_address", "_slot"], "left").select(
        *[c for c in visits.columns if c != "led_to_analysis"], F.coalesce(hit, F.lit(False)).alias("led_to_analysis"))


def sessions(visits: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """Visits per address joined into sessions: a pause of ``gap_minutes`` or more ends one.

    Two visits in the same gap-long slot always belong together, so visits are
    first reduced to one row per address and slot (combined on the map side).
    Only these rows, at most 48 a day for an address, are ordered.
    """
    gap = gap_minutes * 60 * 1_000_000
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    slots = visits.select("ip_address", us.alias("_t")).groupBy(
        "ip_address", F.floor(F.col("_t") / F.lit(gap)).cast("long").alias("_slot")
    ).agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count("*").alias("_n"))
    order = Window.partitionBy("ip_address").orderBy("_slot")
    opens = F.coalesce(F.col("_from") - F.lag("_to").over(order) >= gap, F.lit(True))
    numbered = slots.withColumn("_open", opens.cast("long")).withColumn("session_no", F.sum("_open").over(order))
    return numbered.groupBy("ip_address", "session_no").agg(
        F.timestamp_micros(F.min("_from")).alias("started_at"),
        F.timestamp_micros(F.max("_to")).alias("ended_at"),
        F.sum("_n").alias("n_visits"),
    )
