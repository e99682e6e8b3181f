import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import visitors as vs
from riskloom.sources import memberships as ms
from riskloom.sources import readers


def test_bitmaps_round_trip_and_pick(spark, tmp_path):
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 99_999, 5_000_000_000]
    rows = [("test" if i % 2 else "train", i) for i in ids] + [("test", 7), ("val", None)]
    ms.write_memberships(spark.createDataFrame(rows, "split string, row_id long"), str(tmp_path / "m"))
    stored = ms.read_bitmaps(spark, str(tmp_path / "m"))
    assert sorted((r["split"], r["row_id"]) for r in ms.listed(stored).collect()) == sorted(r for r in set(rows) if r[1] is not None)
    assert {r["split"]: r["n_rows"] for r in ms.split_sizes(stored).collect()} == {"test": sum(i % 2 for i in ids), "train": sum(i % 2 == 0 for i in ids)}
    table = spark.range(0, 40_000).withColumnRenamed("id", "k").withColumn("bits", F.lit("mine"))
    picked = ms.pick(table, stored, "test", "k")
    assert picked.columns == ["k", "bits"] and sorted(r["k"] for r in picked.collect()) == [1, 7, 32767, 32769]
    assert ms.bitmaps(spark.createDataFrame([], "split string, row_id long")).count() == 0


def test_negative_ids_are_refused(spark):
    with pytest.raises(Exception, match="from 0 on"):
        ms.bitmaps(spark.createDataFrame([("a", -1)], "split string, row_id long")).collect()


@pytest.mark.parametrize("most", [200_000, 0])
def test_positions_move_no_row(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(readers, "MOST_FILES", most)
    spark.range(0, 100).withColumn("t", F.concat(F.lit("text "), F.col("id"))).repartition(5).write.parquet(str(tmp_path / "p"))
    placed = readers.parquet_positions(spark.read.parquet(str(tmp_path / "p")))
    if most:
        assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    rows = placed.collect()
    assert sorted(r["row_id"] for r in rows) == list(range(100)) and len({r["id"] for r in rows}) == 100


def test_sketches_merge_over_any_days(spark):
    rows = [(f"10.0.{i % 97}.{i % 53}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(2000)] + [(None, dt.datetime(2024, 1, 2))]
    visits = spark.createDataFrame(rows, "ip_address string, timestamp timestamp")
    days = vs.daily_sketches(visits)
    for first, last in (("2024-01-01", "2024-12-31"), ("2024-01-05", "2024-01-09"), ("2023-01-01", "2023-01-02")):
        exact = {r[0] for r in rows if r[0] and first <= r[1].strftime("%Y-%m-%d") <= last}
        got = vs.totals_between(days, F.lit(first), F.lit(last)).first()
        assert got["total_visitors"] == sum(first <= r[1].strftime("%Y-%m-%d") <= last for r in rows)
        assert abs(got["unique_ips"] - len(exact)) <= 0.03 * len(exact)
