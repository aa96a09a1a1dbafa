"""Returns after revisions equal a full rebuild, whatever the order of files."""

import datetime as dt
import random

from pyspark.sql import functions as F

from realcurve.operators import incremental, walk
from realcurve.plans.panel import Panel
from realcurve.streaming import recompute


def store_of(spark, panel, root):
    rules = panel.land(walk.bond_rules(panel.bonds, panel.conv, panel.series))
    value = lambda q: walk.value_quotes(q, rules, panel._foreign_days)
    store = recompute.ReturnStore(spark, root, value, buckets=4)
    store.build(panel.quotes)
    return store, value


def rows(df):
    return sorted(map(repr, df.collect()))


def test_recompute_equals_a_rebuild(spark, sf_dir, tmp_path):
    panel = Panel(spark, sf_dir)
    store, value = store_of(spark, panel, f"{tmp_path}/store")
    before = {r.bond_id: r.n for r in store.read().groupBy("bond_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    rng = random.Random(5)
    some = sorted(before)[:4]
    revised = [(rng.choice(some), dt.date(1996, 1, 1) + dt.timedelta(rng.randrange(2000)), 90 + rng.random(), 1.0, None, dt.datetime(2024, 1, 1, rng.randrange(24)), i) for i in range(60)]
    revised += [(some[0], dt.date(1990, 1, 1), 95.0, 1.0, None, dt.datetime(2024, 1, 1), 100), (999, dt.date(1997, 1, 1), 95.0, 1.0, None, dt.datetime(2024, 1, 1), 101), (some[1], dt.date(1997, 5, 5), None, 2.0, 1.5, dt.datetime(2024, 1, 2), 102)]
    kind = "bond_id long, date date, clean double, ytm double, vendor_ir double, ts timestamp, event_id long"
    rng.shuffle(revised)
    for i in range(0, len(revised), 13):
        spark.createDataFrame(revised[i : i + 13], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = recompute.drain(store, stream, f"{tmp_path}/checkpoint")
    assert query.lastProgress["stateOperators"] == []
    first = panel.quotes.withColumns({"ts": F.lit(None).cast("timestamp"), "event_id": F.lit(None).cast("long")})
    merged = incremental.newest_cells(first.unionByName(spark.createDataFrame(revised, kind)), ["bond_id", "date"], recompute.VALUES)
    metrics = panel.land(value(merged.drop("ts", "event_id")))
    want = walk.bond_walk(metrics)
    assert rows(store.read()) == rows(want)
    assert rows(store.tables["marks"].read().drop("bucket")) == rows(incremental.month_marks(metrics, panel.land(want)))
    # the same batch again, and one that changes nothing
    last = store.tables["quotes"].last_version()
    store.apply(spark.createDataFrame(revised[:13], kind), 0, f"{tmp_path}/checkpoint")
    assert store.tables["quotes"].last_version() == last
    version = store.tables["returns"].last_version()
    store.apply(spark.createDataFrame(revised[:20], kind), 7, "another")
    assert store.tables["returns"].last_version() == version and rows(store.read()) == rows(want)
    store.expire()
    assert rows(store.read()) == rows(want)


def test_only_touched_bonds_are_walked(spark, sf_dir, tmp_path):
    panel = Panel(spark, sf_dir)
    store, value = store_of(spark, panel, f"{tmp_path}/store")
    seen = []

    def noted(q):
        seen.append({(r.bond_id, r.date) for r in q.select("bond_id", "date").collect()})
        return value(q)

    store.value = noted
    bond, day = store.read().where("date >= '1999-06-10'").select("bond_id", "date").orderBy("bond_id", "date").first()
    kind = "bond_id long, date date, clean double, ytm double, vendor_ir double, ts timestamp, event_id long"
    store.apply(spark.createDataFrame([(bond, day, 50.0, 1.0, None, dt.datetime(2024, 1, 1), 1)], kind), 0)
    assert len(seen) == 1 and {b for b, _ in seen[0]} == {bond} and min(d for _, d in seen[0]) >= day.replace(day=1)


def test_a_batch_that_broke_off_goes_through_again(spark, sf_dir, tmp_path, monkeypatch):
    import pytest

    panel = Panel(spark, sf_dir)
    store, value = store_of(spark, panel, f"{tmp_path}/store")
    bond, day = store.read().select("bond_id", "date").orderBy("bond_id", "date").first()
    kind = "bond_id long, date date, clean double, ytm double, vendor_ir double, ts timestamp, event_id long"
    batch = spark.createDataFrame([(bond, day, 50.0, 1.0, None, dt.datetime(2024, 1, 1), 1)], kind)
    quotes, publish = store.tables["quotes"], store.tables["quotes"].publish
    quotes.publish = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.apply(batch, 0)
    half = rows(store.read())
    quotes.publish = publish
    store.apply(batch, 0)
    assert rows(store.read()) == half and quotes.read().where("event_id = 1").count() == 1
