"""A late file revises only its own months; replaying a batch changes nothing."""

import datetime as dt

from realcurve.streaming import topup


def write(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def test_late_revision_wins_and_old_rows_stay(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/out"
    t = lambda m, d, h=0: dt.datetime(2024, m, d, h)
    write(spark, src, [(1, t(1, 30), 7, "q", 10.0), (2, t(2, 1), 7, "q", 11.0)])
    first = topup.drain(topup.newest_by_day(topup.revision_stream(spark, src)), root, ["bond_id", "date"], "date")
    assert {(r["date"].day, r["clean"]) for r in first.collect()} == {(30, 10.0), (1, 11.0)}
    write(spark, src, [(3, t(2, 1, 5), 7, "q", 12.0), (4, t(2, 2), 8, "q", 20.0)])
    second = topup.drain(topup.newest_by_day(topup.revision_stream(spark, src)), root, ["bond_id", "date"], "date")
    want = {(7, 30, 10.0, 1), (7, 1, 12.0, 2), (8, 2, 20.0, 1)}
    assert {(r["bond_id"], r["date"].day, r["clean"], r["updates"]) for r in second.collect()} == want
    again = topup.drain(topup.newest_by_day(topup.revision_stream(spark, src)), root, ["bond_id", "date"], "date")
    assert again.count() == 3


def test_files_out_of_order_lose_nothing(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, month in enumerate((6, 7, 5)):
        write(spark, src, [(i, dt.datetime(2024, month, 3), i, "q", 10.0 + i)])
        got = topup.drain(topup.newest_by_day(topup.revision_stream(spark, src)), root, ["bond_id", "date"], "date")
    assert {(r["bond_id"], r["date"].month, r["clean"]) for r in got.collect()} == {(0, 6, 10.0), (1, 7, 11.0), (2, 5, 12.0)}


def test_an_older_file_of_another_query_does_not_win(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 3, 1, d)
    keys, root = ["bond_id", "date"], f"{tmp_path}/out"
    for i, (at, value) in enumerate(((5, 10.0), (4, 9.0), (6, 11.0), (6, 8.0))):
        src = f"{tmp_path}/in{i}"
        write(spark, src, [(10 - i, t(at), 7, "q", value)])
        rows = topup.newest_by_day(topup.revision_stream(spark, src))
        topup.start_topup(rows, f"{root}/table", f"{root}/checkpoint{i}", keys, "date").awaitTermination()
    got = topup.landed_table(rows, f"{root}/table", "date").read().collect()
    assert [(r.clean, r.updates) for r in got] == [(11.0, 4)]  # of equal times the greater event id


def test_the_stream_has_no_state_and_leaves_only_live_parts(spark, tmp_path):
    import os

    src, root = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, month in enumerate((1, 2, 1, 1)):
        write(spark, src, [(i, dt.datetime(2024, month, 3 + i), i, "q", 10.0 + i)])
        rows = topup.newest_by_day(topup.revision_stream(spark, src))
        query = topup.start_topup(rows, f"{root}/table", f"{root}/checkpoint", ["bond_id", "date"], "date")
        query.awaitTermination()
        assert query.lastProgress["stateOperators"] == []
    table = topup.landed_table(rows, f"{root}/table", "date")
    parts = [d for d, _, names in os.walk(f"{root}/table/data") if any(n.endswith(".parquet") for n in names)]
    assert len(parts) == len(table.live()) == 2 and table.read().count() == 4


def test_a_replayed_batch_is_merged_once(spark, tmp_path):
    from realcurve.sources.versioned import VersionedTable

    keys, root = ["bond_id", "date"], f"{tmp_path}/table"
    kind = "bond_id long, date date, clean double, updates long, ts timestamp, event_id long, month date"
    row = (7, dt.date(2024, 3, 1), 1.0, 1, dt.datetime(2024, 3, 1), 1, dt.date(2024, 3, 1))
    table = VersionedTable(spark, root, spark.createDataFrame([], kind).schema, "month")
    assert table.read().count() == 0 and not table.applied("s", 0)
    table.publish(spark.createDataFrame([row], kind), source="s", batch=0)
    assert table.applied("s", 0) and not table.applied("s", 1)
    # a write without its manifest is not seen, and the next one writes over it
    spark.createDataFrame([row], kind).write.partitionBy("month").parquet(f"{root}/data/version=1")
    assert table.read().count() == 1
    table.publish(topup.newest(table.read().union(spark.createDataFrame([row], kind)), keys).withColumn("month", topup.month_start(topup.F.col("date"))), source="s", batch=1)
    assert [r.updates for r in table.read().collect()] == [2]
    table.publish(table.read().where("1 = 0"), ["2024-03-01"])
    assert table.read().count() == 0 and table.expire() >= 1
