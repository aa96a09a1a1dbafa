"""Days before and after the calendars and curves, and the list of ids that never trade."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from realcurve import session
from realcurve.operators import calendars, hedge, issuance
from realcurve.sources import landed

OPEN = [dt.date(2000, 1, 3), dt.date(2000, 1, 4), dt.date(2000, 1, 5)]


@pytest.fixture
def calendar(spark):
    return spark.createDataFrame([("US", d, i + 1) for i, d in enumerate(OPEN)], "cal_id string, date date, seq int")


def test_settlement_counts_from_the_first_open_day_and_stops_at_the_last(spark, calendar):
    days = [dt.date(1990, 5, 1), dt.date(2000, 1, 2), dt.date(2000, 1, 3), dt.date(2010, 1, 1)]
    obs = spark.createDataFrame([("US", 2, d) for d in days], "cal_id string, settle_lag int, date date")
    got = {r["date"]: r["settle"] for r in calendars.settle_join(obs, calendar, obs.select("cal_id", "settle_lag").distinct()).collect()}
    assert got == {days[0]: OPEN[1], days[1]: OPEN[1], days[2]: OPEN[2], days[3]: OPEN[2]}


def test_open_days_around_a_calendar(spark, calendar):
    days = [dt.date(1990, 5, 1), OPEN[0], OPEN[2], dt.date(2010, 1, 1), None]
    obs = spark.createDataFrame([(d,) for d in days], "d date")
    first = {r["d"]: r["bday"] for r in calendars.first_bday_on_or_after(obs, calendar, "d", "US").collect()}
    assert first == {days[0]: OPEN[0], OPEN[0]: OPEN[0], OPEN[2]: OPEN[2], days[3]: None, None: None}
    after = {r["d"]: r["n"] for r in calendars.next_bday(obs, calendar, "d", "US", "n").collect()}
    assert after == {days[0]: OPEN[0], OPEN[0]: OPEN[1], OPEN[2]: dt.date(2000, 1, 6), days[3]: dt.date(2010, 1, 4), None: None}


def test_rates_are_carried_without_end(spark):
    curves = spark.createDataFrame([("r", OPEN[0], 1.0), ("r", OPEN[2], 2.0)], "repo_id string, date date, rate double")
    days = [dt.date(1999, 1, 1), OPEN[1], dt.date(2020, 1, 1)]
    obs = spark.createDataFrame([("r", d) for d in days], "repo_id string, date date")
    assert {r["date"]: r["gc"] for r in landed.asof_rate(obs, curves).collect()} == {days[0]: None, days[1]: 1.0, days[2]: 2.0}


def test_ids_that_never_trade_have_no_issuance(spark):
    day = dt.date(2000, 1, 1)
    bonds = spark.createDataFrame([(i, True, False, "m", "c", day, dt.date(2010, 1, 1), 1e9, 1e9) for i in (1, 2)],
                                  "bond_id long, linked boolean, deferred boolean, market string, country string, issue date, maturity date, amt_issued double, amt_out double")
    idle = spark.createDataFrame([(2,), (2,)], "bond_id long")
    assert [r["bond_id"] for r in issuance.bond_issuance(bonds, idle).collect()] == [1]


def test_pairs_without_a_breakeven_are_left_out(spark):
    legs = spark.createDataFrame([("10y", OPEN[0], 1.0, 2.0), ("10y", OPEN[1], 1.0, None)], "tenor string, date date, r_linked_bp double, r_nominal_bp double")
    energy = spark.createDataFrame([(d, 5.0) for d in OPEN], "date date, usd_per_contract double")
    assert hedge.aligned_pairs(legs, energy, ["tenor"]).count() == 1
    assert hedge.aligned_pairs(legs, energy, ["tenor"], partial=True).agg(F.count("linked_usd")).first()[0] == 2


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Cluster())
