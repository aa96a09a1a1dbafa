"""Marts in two formats, the hand-kept pair map, payload documents."""

import datetime as dt
import json

import pytest

from realcurve.operators import exports
from realcurve.sources import cleaning
from realcurve.sources.marts import Mart, write_mart

KIND = "id long, day date, name string, level double, flag boolean, at timestamp"
ROWS = [
    (1, dt.date(2001, 2, 3), 'say "hi", all\nnew line \\ back', 0.1 + 0.2, True, dt.datetime(2001, 2, 3, 4, 5, 6)),
    (2, None, "", None, None, None), (3, dt.date(1999, 1, 1), None, 1e300, False, None), (4, None, " outer ", -0.0, None, None), (4, None, " outer ", -0.0, None, None), (5, None, "#", 1.0, True, None)]


def shown(df):
    return sorted(map(repr, df.collect()))


def test_both_copies_hold_the_same_rows(spark, tmp_path):
    mart = Mart(spark, f"{tmp_path}/mart")
    df = spark.createDataFrame(ROWS, KIND)
    assert mart.publish(df) == 0
    assert shown(mart.read("parquet")) == shown(mart.read("csv")) == shown(df)
    assert mart.manifest().collect()[0]["rows"] == len(ROWS)
    assert not write_mart(df.where("1 = 0"), f"{tmp_path}/none") and mart.publish(df.where("1 = 0")) is None
    assert mart.read().count() == len(ROWS)
    with pytest.raises(ValueError):
        mart.read("xml")
    with pytest.raises(FileNotFoundError):
        Mart(spark, f"{tmp_path}/none").read()


def test_a_crash_between_the_formats_leaves_the_old_version(spark, tmp_path, monkeypatch):
    mart = Mart(spark, f"{tmp_path}/mart")
    df = spark.createDataFrame(ROWS, KIND)
    mart.publish(df)
    more = df.union(df)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(mart, "_write_csv", lost)
        with pytest.raises(RuntimeError):
            mart.publish(more)
    assert mart.version() == 0 and shown(mart.read("parquet")) == shown(mart.read("csv")) == shown(df)
    # a copy that differs is not shown either
    with monkeypatch.context() as m:
        m.setattr(mart, "_write_csv", lambda written, path, own=mart._write_csv: own(written.where("id <> 1"), path))
        with pytest.raises(ValueError):
            mart.publish(more)
    assert shown(mart.read()) == shown(df)
    assert mart.publish(more) == 1 and mart.read("csv").count() == 2 * len(ROWS)
    mart.expire()
    assert mart.read().count() == 2 * len(ROWS)


def test_map_files_of_three_shapes(spark, tmp_path):
    (tmp_path / "map").mkdir()
    for i, text in enumerate((
        "# by hand\nreal_id,nominal_id,beta,note\nA,B,0.5,\"x, y # z\"  # remark\n\n#C,D,1,out\nE,F,,\n",
        "note,nominal_id,real_id\nn1,H,G\n , ,K\n",
        "beta,real_id,more,nominal_id\nhalf,I,#,J\n2,L,m,N\n",
        "no,header,here\n1,2,3\n")):
        (tmp_path / "map" / f"{i}.csv").write_text(text)
    got = {tuple(r) for r in cleaning.read_pair_map(spark, f"{tmp_path}/map").collect()}
    assert got == {("A", "B", "0.5", "x, y # z"), ("E", "F", None, None), ("G", "H", None, "n1"), ("K", None, None, None), ("I", None, "half", None), ("L", "N", "2", None)}
    from realcurve.operators.pairs import scan_pair_map

    kept = {(r.real_id, r.beta) for r in scan_pair_map(cleaning.read_pair_map(spark, f"{tmp_path}/map")).collect()}
    assert kept == {("A", 0.5), ("E", 1.0), ("G", 1.0), ("L", 2.0)}
    assert cleaning.read_pair_map(spark, f"{tmp_path}/absent").columns == cleaning.PAIR_COLUMNS
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "a.csv").write_text("# nothing\n")
    assert cleaning.read_pair_map(spark, f"{tmp_path}/bare").count() == 0


def test_market_documents(spark):
    week = lambda d: dt.date(2001, 1, d)
    kind = "market string, kind string, key string, week date, out double, be double, slip_l double, slip_n double, crude double, crude_b double"
    rows = [("M", "bucket", "5y", week(12), 2.5, None, 1.0, None, 7.0, 0.12345), ("M", "bucket", "5y", week(5), -1.2, None, None, None, 6.4, 0.12345), ("M", "bond", "7", week(5), 0.0, 3.6, None, None, None, None)]
    got = {r.key: (r.weeks, json.loads(r.payload)) for r in exports.market_payload(spark.createDataFrame(rows, kind)).collect()}
    assert got["5y"] == (2, {"x": ["2001-01-05", "2001-01-12"], "out": [-1, 2], "slip_l": [None, 1], "crude": [6, 7], "crude_b": 0.1235}) or got["5y"][1]["crude_b"] in (0.1234, 0.1235)
    assert got["7"] == (1, {"x": ["2001-01-05"], "out": [0], "be": [4]})
    assert exports.market_payload(spark.createDataFrame([], kind)).count() == 0
