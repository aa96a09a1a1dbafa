"""All derived frames of one data folder, each a lazy plan built on first use.

Frames bounded by the calendar (series, day dimensions, rolls, tenor and bucket days) are landed as
small tables in the shared checkpoint folder when first used, because later steps read them several
times; frames that grow with the number of bonds or quotes stay lazy.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Landing
from ..operators import cmt, futures as fut, hedge, issuance, pairs, refindex, rolls, seasonal, walk
from ..operators.calendars import trading_calendar
from ..sources import conventions as cv
from ..sources import driver_tables as src

EMIT_FROM = "1996-01-01"
AS_OF = "2001-12-01"
PAIR_DAYS_PER_YEAR = 5  # the derived panel quotes a bond every few days, so a full window is sparser than daily


class Panel:
    """Frames over the driver tables. ``emit_from`` is where published series start."""

    def __init__(self, spark: SparkSession, sf_dir: str, emit_from: str = EMIT_FROM, as_of: str = AS_OF):
        self.spark, self.sf_dir, self.emit_from, self.as_of = spark, sf_dir, emit_from, as_of
        self.land = Landing(spark)

    # ---- landed tables
    @cached_property
    def bonds(self) -> DataFrame:
        return src.bonds(self.spark, self.sf_dir)

    @cached_property
    def idle(self) -> DataFrame:
        return src.non_traded(self.spark, self.sf_dir)

    @cached_property
    def quotes(self) -> DataFrame:
        return src.raw_quotes(self.spark, self.sf_dir)

    @cached_property
    def series(self) -> DataFrame:
        # days times a dozen series; read by every curve, index and calendar, so landed after one scan
        return self.land(src.series(self.spark, self.sf_dir))

    @cached_property
    def auctions(self) -> DataFrame:
        return src.auctions(self.spark, self.sf_dir)

    @cached_property
    def taps(self) -> DataFrame:
        return src.events(self.spark, self.sf_dir)

    @cached_property
    def outstanding(self) -> DataFrame:
        return src.outstanding(self.spark, self.sf_dir)

    @cached_property
    def pair_map(self) -> DataFrame:
        return src.pair_map(self.spark, self.sf_dir)

    @cached_property
    def futures(self) -> DataFrame:
        return src.futures(self.spark, self.sf_dir)

    @cached_property
    def conv(self) -> DataFrame:
        return cv.conventions(self.spark)

    @cached_property
    def calendar(self) -> DataFrame:
        return self.land(trading_calendar(self.series))

    # ---- pricing and per-bond walk
    @cached_property
    def _domestic_days(self) -> DataFrame:
        return self.land(refindex.market_days(self.conv.where(F.col("conv_id").startswith("US_")), self.series, self.calendar))

    @cached_property
    def _foreign_days(self) -> DataFrame:
        return self.land(refindex.market_days(self.conv.where(~F.col("conv_id").startswith("US_")), self.series, self.calendar))

    def metrics(self, only: DataFrame | None = None, domestic: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
        """Quotes valued at settlement; ``only`` prunes the raw scan to the bonds wanted."""
        q = src.raw_quotes(self.spark, self.sf_dir, only)
        key = "us_conv_id" if domestic else "conv_id"
        return walk.value_quotes(q, walk.bond_rules(self.bonds, self.conv, self.series, key, keep), self._domestic_days if domestic else self._foreign_days)

    @cached_property
    def bond_returns(self) -> DataFrame:
        return walk.bond_walk(self.metrics(keep=("linked", "market", "country")), ("linked", "market", "country"))

    def returns_of(self, only: DataFrame) -> DataFrame:
        return walk.bond_walk(self.metrics(only=only))

    @cached_property
    def linked_returns(self) -> DataFrame:
        """Returns of linked bonds only, with their market."""
        linked = self.bonds.where("linked").select("bond_id")
        return walk.bond_walk(self.metrics(only=linked, keep=("market",)), ("market",))

    @cached_property
    def pair_levels(self) -> DataFrame:
        """The breakevens of ``pair_returns`` without the legs' valuation."""
        return pairs.pair_breakeven(self.returns_of(pairs.mapped_bonds(self.pair_map)), self.pair_map, pairs.BREAKEVEN_FIELDS)

    @cached_property
    def pair_returns(self) -> DataFrame:
        return pairs.pair_breakeven(self.returns_of(pairs.mapped_bonds(self.pair_map)), self.pair_map)

    # ---- domestic tenor series
    @cached_property
    def schedule(self) -> DataFrame:
        return rolls.otr_schedule(self.auctions, src.last_quote_month(self.spark, self.sf_dir))

    @cached_property
    def rolls(self) -> DataFrame:
        return self.land(rolls.roll_schedule(self.auctions, self.calendar, settle=self.land))

    @cached_property
    def issue_days(self) -> DataFrame:
        return rolls.issue_date_min(self.auctions)

    @cached_property
    def spans(self) -> DataFrame:
        return self.land(rolls.roll_effective(self.rolls, self.issue_days, self.calendar))

    @cached_property
    def legs(self) -> DataFrame:
        held = self.spans.select("bond_id").distinct()
        return self.land(walk.leg_walk(self.metrics(only=F.broadcast(held), domestic=True), self.spans, self.emit_from))

    @cached_property
    def tenors(self) -> DataFrame:
        return self.land(walk.tenor_returns(self.legs))

    @cached_property
    def anchors(self) -> DataFrame:
        return self.land(seasonal.month_anchors(seasonal.monthly_anchor(self.auctions, self.emit_from), self.calendar))

    @cached_property
    def gasoline(self) -> DataFrame:
        return self.land(fut.futures_splice_month(self.futures, self.calendar, emit_from=self.emit_from))

    @cached_property
    def crude(self) -> DataFrame:
        return self.land(fut.futures_splice_ticker(self.futures, self.calendar, emit_from=self.emit_from))

    @cached_property
    def gas_days(self) -> DataFrame:
        return self.gasoline.select("date", F.col("usd_per_contract").alias("gas_usd"))

    @cached_property
    def seasonal(self) -> DataFrame:
        return self.land(seasonal.seasonal_table(self.tenors, self.anchors, self.gas_days))

    @cached_property
    def pairs_gas(self) -> DataFrame:
        return self.land(hedge.aligned_pairs(self.tenors, self.gasoline, ["tenor"]))

    @cached_property
    def pairs_crude(self) -> DataFrame:
        return self.land(hedge.aligned_pairs(self.tenors, self.crude, ["tenor"]))

    @cached_property
    def leg_betas(self) -> DataFrame:
        return self.land(hedge.walk_forward_leg_betas(self.pairs_gas, ["tenor"], per_year=PAIR_DAYS_PER_YEAR))

    @cached_property
    def hedge_2y(self) -> DataFrame:
        return hedge.month_hedge(self.leg_betas, "2y")

    # ---- international buckets
    @cached_property
    def issuance(self) -> DataFrame:
        return issuance.bond_issuance(self.bonds, self.idle)

    @cached_property
    def events(self) -> DataFrame:
        return issuance.events_log(self.issuance, self.taps)

    @cached_property
    def pool(self) -> DataFrame:
        quoted = self.land(src.quoted_bonds(self.spark, self.sf_dir))  # ids only; the pool looks them up three times
        return cmt.nominal_pool(src.nominal_universe(self.spark, self.sf_dir), self.pair_map, self.bonds, quoted)

    @cached_property
    def held(self) -> DataFrame:
        return self.land(cmt.held_monthly(self.events, self.as_of))

    @cached_property
    def matched(self) -> DataFrame:
        return self.land(cmt.holdings(self.held, self.pool))

    @cached_property
    def tagged(self) -> DataFrame:
        return issuance.auctions_by_bucket(self.events)

    @cached_property
    def buckets(self) -> DataFrame:
        returns = self.returns_of(cmt.needed_bonds(self.matched))
        return self.land(cmt.bucket_series(returns, self.matched, self.tagged))

    @cached_property
    def pairs_buckets(self) -> DataFrame:
        return self.land(hedge.aligned_pairs(self.buckets, self.crude, ["market", "bucket"], partial=True))
