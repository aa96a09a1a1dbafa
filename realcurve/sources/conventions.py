"""Market conventions: small dimensions stated as fixed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# One row per instrument type.
# conv_id, country, program, index_id, freq, freq_default, settle_lag, cal_id, floor, quote, ccy, repo_id, lag_months, interp, deferred, rounding
CONV_COLUMNS = ["conv_id", "country", "program", "index_id", "freq", "freq_default", "settle_lag", "cal_id", "floor",
                "quote", "ccy", "repo_id", "lag_months", "interp", "deferred", "rounding"]
LINKED_MARKETS = [
    ("FR_OATEI", "FR", "OAT€i", "EUR_HICPXT", 1, None, 2, "TARGET2", True, "real", "EUR", "rfr_fr", 3, True, False, "round"),
    ("FR_OATI", "FR", "OATi", "FR_CPIXT", 1, None, 2, "TARGET2", True, "real", "EUR", "rfr_fr", 3, True, False, "round"),
    ("IT_BTPEI", "IT", "BTP€i", "EUR_HICPXT", 2, None, 2, "TARGET2", True, "real", "EUR", "rfr_it", 3, True, False, "round"),
    ("ES_EI", "ES", "Bonos/Oblig€i", "EUR_HICPXT", 1, None, 2, "TARGET2", True, "real", "EUR", "rfr_es", 3, True, False, "round"),
    ("DE_EI", "DE", "Bund/Bobl€i", "EUR_HICPXT", 1, None, 2, "TARGET2", True, "real", "EUR", "rfr_de", 3, True, False, "round"),
    ("UK_3M", "GB", "UKTi (3m-lag)", "UK_RPI", 2, None, 1, "UK", False, "real", "GBP", "sonia_gc", 3, True, False, "round"),
    ("UK_8M", "GB", "UKTi (8m-lag)", "UK_RPI", 2, None, 1, "UK", False, "nominal", "GBP", "sonia_gc", 8, False, True, "round"),
    ("IT_ITALIA", "IT", "BTP Italia", "IT_FOIXT", 2, None, 2, "TARGET2", True, "par_reset", "EUR", "estr_gc", 3, True, True, "round"),
]
NOMINAL_MARKETS = [
    ("NOM_FR", "FR", "nominal govt", None, None, 1, 2, "TARGET2", False, "nominal", "EUR", "rfr_fr", 3, True, False, "round"),
    ("NOM_DE", "DE", "nominal govt", None, None, 1, 2, "TARGET2", False, "nominal", "EUR", "rfr_de", 3, True, False, "round"),
    ("NOM_IT", "IT", "nominal govt", None, None, 2, 2, "TARGET2", False, "nominal", "EUR", "rfr_it", 3, True, False, "round"),
    ("NOM_ES", "ES", "nominal govt", None, None, 1, 2, "TARGET2", False, "nominal", "EUR", "rfr_es", 3, True, False, "round"),
    ("NOM_GB", "GB", "nominal govt", None, None, 2, 1, "UK", False, "nominal", "GBP", "sonia_gc", 3, True, False, "round"),
]
US_MARKETS = [
    ("US_LINKED", "US", "TIPS", "cpi_nsa", 2, None, 1, "US", True, "real", "USD", "us_gc", 3, True, False, "trunc"),
    ("US_NOMINAL", "US", "Treasury", None, 2, None, 1, "US", False, "nominal", "USD", "us_gc", 3, True, False, "trunc"),
]
COUNTRIES = ["FR", "IT", "ES", "DE", "GB"]
LONG_END_MARKETS = ["FR_OATEI", "FR_OATI", "UK_3M"]
CYCLE_MARKETS = ["IT_BTPEI", "FR_OATEI", "FR_OATI", "ES_EI", "UK_3M"]

# Which printed series makes a day a business day, and how repo curves are spliced.
CALENDAR_SERIES = {"US": "fed_funds", "TARGET2": "eonia", "UK": "sonia_gc"}
REPO_LADDERS = {
    "us_gc": [("gcf_treasury", 0.0), ("gc_repo_on", 0.0), ("fed_funds", 0.0)],
    "sonia_gc": [("sonia_gc", 0.0)],
    "estr_gc": [("estr_gc", 0.0), ("eonia", -0.085)],
    "rfr_fr": [("rfr_fr", 0.0), ("estr_gc", 0.0), ("eonia", -0.085)],
    "rfr_de": [("rfr_de", 0.0), ("estr_gc", 0.0), ("eonia", -0.085)],
    "rfr_it": [("rfr_it", 0.0), ("estr_gc", 0.0), ("eonia", -0.085)],
    "rfr_es": [("rfr_es", 0.0), ("estr_gc", 0.0), ("eonia", -0.085)],
}
MONTHLY_INDICES = ["cpi_nsa", "EUR_HICPXT", "FR_CPIXT", "UK_RPI", "IT_FOIXT"]

# Estimated auction day of each market (weekday, n-th of the month).
AUCTION_RULES = {"FR_OATEI": ("THU", 3), "FR_OATI": ("THU", 3), "ES_EI": ("THU", 1), "IT_BTPEI": ("TUE", 4)}

# Expected maturity months (linked, nominal) of the held pair by calendar month.
PAIRING_30Y = {m: (2, 2) for m in range(1, 13)}
PAIRING_5Y = {m: (4, 4) if 5 <= m <= 10 else (10, 10) for m in range(1, 13)}
PAIRING_10Y = {1: (7, 8), 2: (1, 11), 3: (1, 2), 4: (1, 2), 5: (1, 2), 6: (1, 2), 7: (1, 2), 8: (7, 5), 9: (7, 8),
               10: (7, 8), 11: (7, 8), 12: (7, 8)}


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values_clause(rows: Sequence[tuple]) -> str:
    return ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)


def inline(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A constant relation that stays in the plan (its size is known to the optimizer)."""
    return spark.sql(f"SELECT * FROM VALUES {values_clause(rows)} AS t({', '.join(columns)})")


def conventions(spark: SparkSession) -> DataFrame:
    return inline(spark, CONV_COLUMNS, LINKED_MARKETS + NOMINAL_MARKETS + US_MARKETS)


def market_matrix(spark: SparkSession) -> DataFrame:
    """Linked-market conventions as a table."""
    return inline(spark, CONV_COLUMNS, LINKED_MARKETS).withColumnRenamed("conv_id", "market").drop("freq_default", "rounding")


def expected_pairing(spark: SparkSession) -> DataFrame:
    rows = [(t, m, *pair) for t, table in (("5y", PAIRING_5Y), ("10y", PAIRING_10Y), ("30y", PAIRING_30Y))
            for m, pair in table.items()]
    return inline(spark, ["tenor", "month", "linked_month", "nominal_month"], rows)
