import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import visitors as vs

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def data():
    draw = random.Random(4)
    rows = []
    for i in range(600):
        ip = "10.0.0.1" if i % 3 == 0 else f"10.0.1.{draw.randint(0, 9)}"
        rows.append((i, ip, draw.choice(["/", "/a", "/b"]), draw.choice(["Chrome", None, ""]), "desktop", "Linux",
                     START + dt.timedelta(seconds=draw.randint(0, 6 * 86400))))
    return rows


@pytest.fixture(scope="module")
def visits(spark, data):
    df = spark.createDataFrame(
        data, "id long, ip_address string, path string, browser string, device_type string, os string, timestamp timestamp_ntz")
    return df.withColumn("method", F.lit("GET")).withColumn("led_to_analysis", F.lit(False)).repartition(5)


def _sessions(times, gap):
    times = sorted(times)
    out = [[times[0]]]
    for before, now in zip(times, times[1:]):
        if now - before >= gap:
            out.append([])
        out[-1].append(now)
    return [(s[0], s[-1], len(s)) for s in out]


@pytest.mark.parametrize("minutes", [30, 7])
def test_sessions(visits, data, minutes):
    got = sorted((r["ip_address"], r["session_no"], r["n_visits"]) for r in vs.sessions(visits, minutes).collect())
    by_ip = {}
    for _, ip, *_, ts in data:
        by_ip.setdefault(ip, []).append(ts)
    expected = sorted(
        (ip, n + 1, count) for ip, times in by_ip.items()
        for n, (_, _, count) in enumerate(_sessions(times, dt.timedelta(minutes=minutes))))
    assert got == expected


def test_a_pause_of_exactly_the_gap_ends_a_session(spark):
    rows = [("x", START), ("x", START + dt.timedelta(minutes=30)), ("x", START + dt.timedelta(minutes=59))]
    df = spark.createDataFrame(rows, "ip_address string, timestamp timestamp_ntz")
    assert sorted(r["n_visits"] for r in vs.sessions(df, 30).collect()) == [1, 2]


def test_mark_analyses(spark, visits, data):
    analyses = visits.where("path = '/b'").select("ip_address", "timestamp")
    got = {r["id"]: r["led_to_analysis"] for r in vs.mark_analyses(visits, analyses, 30).collect()}
    marks = [(ip, ts) for _, ip, path, *_, ts in data if path == "/b"]
    half = dt.timedelta(minutes=30)
    assert got == {i: any(ip == a and ts <= t <= ts + half for a, t in marks) for i, ip, *_, ts in data}


def test_breakdowns_show_nulls_as_unknown(visits):
    rows = vs.breakdowns(visits).where("dimension = 'browser'").collect()
    assert {r["name"] for r in rows} == {"Chrome", "Unknown"} and len(rows) == 3  # null and '' stay apart
    assert sum(r["n_visits"] for r in rows) == 600


def test_trailing_window_and_retention_agree_on_the_bound(visits):
    asof = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    kept = vs.keep_recent(visits, asof, 2)
    assert kept.count() == visits.where("timestamp >= timestamp_ntz'2024-01-03 00:00:00'").count()
    assert vs.trailing(visits, asof, 2).count() == kept.count()


def test_headline_counts_top_paths_only(spark):
    rows = [(i, f"/p{i % 12}") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, path string")
    row = vs.headline(df, 7).first()
    assert (row["total_visitors"], row["page_views"], row["avg_daily"]) == (120, 100, 17)
    assert vs.headline(df.where("id < 0"), 7).first()["avg_daily"] == 0


def test_bars_are_relative_to_the_whole_list(spark):
    df = spark.createDataFrame([("d", f"n{i}", 10 * (i + 1)) for i in range(8)], "dimension string, name string, n_visits long")
    rows = vs.bars(df).orderBy("rank").collect()
    assert [r["name"] for r in rows] == ["n7", "n6", "n5", "n4", "n3"]
    assert rows[0]["width"] == 100.0 and rows[-1]["width"] == 50.0


def test_recent_is_masked(visits):
    rows = vs.recent(visits, 5).collect()
    assert len(rows) == 5 and all(r["ip_address"].endswith(".xxx") for r in rows)


def test_approximate_totals_are_close(visits):
    exact, rough = vs.totals(visits).first(), vs.approximate_totals(visits).first()
    assert exact["total_visitors"] == rough["total_visitors"] == 600
    assert abs(exact["unique_ips"] - rough["unique_ips"]) <= 1


def test_ingest(spark):
    agent = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile Safari/604.1" + "x" * 600
    rows = [(1, "1.1.1.1, 2.2.2.2", "9.9.9.9", agent, "/", "GET"), (2, None, "9.9.9.9", None, "/x", "GET"),
            (3, None, "9.9.9.9", "curl/8.0", "/api/x", "GET")]
    df = spark.createDataFrame(rows, "id long, forwarded string, peer string, user_agent string, path string, method string")
    got = {r["id"]: r for r in vs.ingest(df.withColumn("timestamp", F.current_timestamp())).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["ip_address"], got[1]["browser"], got[1]["device_type"], got[1]["os"]) == ("1.1.1.1", "Mobile Safari", "iPhone", "iOS")
    assert len(got[1]["user_agent"]) == 500
    assert (got[2]["browser"], got[2]["user_agent"]) == ("Other", "")
