"""Cleaning of raw exports: auction records, comparator reports, bond lists, operation lines, tap files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import first_in_order
from . import conventions as cv

TERMS = {"5-Year": "5y", "10-Year": "10y", "30-Year": "30y"}  # fixed values


# ------------------------------------------------------------------ auction records
def raw_auction_text(auctions: DataFrame) -> DataFrame:
    """Auction rows as the public service prints them: all text, odd casing, gaps, repeats."""
    k = F.col("bond_id")
    term = F.regexp_replace("tenor", "y$", "-Year")
    text = auctions.select(
        "bond_id", F.when(F.col("leg") == "linked", F.when(k % 4 == 0, " yes ").otherwise("Yes")).when(k % 3 == 0, "No").alias("tips"),
        F.when(k % 23 == 5, "7-Year").otherwise(term).alias("term"), F.date_format("auction_date", "yyyy-MM-dd").alias("auction_date"),
        F.when(k % 9 == 2, "pending").otherwise(F.date_format("issue_date", "yyyy-MM-dd")).alias("issue_date"),
        F.date_format("maturity_date", "yyyy-MM-dd").alias("maturity_date"),
        F.when(k % 8 == 3, "n/a").otherwise(F.format_string("%.2f", "offering")).alias("offering"), F.date_format("issue_date", "yyyy-MM-dd").alias("seq"),
    )
    return text.unionByName(text.where("bond_id % 5 = 0"))


def normalize_auctions(raw: DataFrame) -> DataFrame:
    """Leg from the flag, typed cells with bad ones null, tracked terms only, first row per bond and day."""
    linked = F.lower(F.trim(F.coalesce("tips", F.lit("no")))) == "yes"
    tenor = F.element_at(F.create_map(*[F.lit(x) for pair in TERMS.items() for x in pair]), F.col("term"))
    date = lambda c: F.col(c).try_cast("date").alias(c)
    typed = raw.where(F.col("term").isin(*TERMS)).select(
        "bond_id", F.when(linked, "linked").otherwise("nominal").alias("leg"), tenor.alias("tenor"), date("auction_date"), date("issue_date"),
        date("maturity_date"), F.col("offering").try_cast("double").alias("offering"), "seq",
    )
    return first_in_order(typed, ["bond_id", "auction_date"], [F.col("seq")]).drop("seq")


def days_by_leg(calendar: DataFrame, spans: DataFrame, cal_id: str = "US") -> DataFrame:
    """Open days of every (leg, tenor) from its first roll on."""
    first = spans.groupBy("leg", "tenor").agg(F.min("eff").alias("lo")).withColumn("cal_id", F.lit(cal_id))
    return calendar.join(F.broadcast(first), "cal_id").where(F.col("date") >= F.col("lo")).select("leg", "tenor", "date")


# ------------------------------------------------------------------ comparator report
def comparator_report(bonds: DataFrame) -> DataFrame:
    """Report rows as received: padded ids, repeats across two months, ids outside the universe."""
    k = F.col("bond_id")
    base = bonds.where("linked").where(k % 10 != 6).select(
        F.concat(F.lit(" "), k.cast("string"), F.lit("  ")).alias("isin"), F.concat(F.lit("L"), k.cast("string")).alias("issue"),
        F.when(k % 14 != 0, (k + 1).cast("string")).alias("comparator_isin"), F.concat(F.lit("N"), (k + 1).cast("string")).alias("comparator"),
        (0.5 + (k % 5) / 10.0).alias("beta_1m"), (0.6 + (k % 4) / 10.0).alias("beta_3m"), F.lit(1).alias("file_no"),
    )
    later = base.where("trim(isin) % 4 = 0").withColumns({"file_no": F.lit(2), "comparator_isin": F.concat("comparator_isin", F.lit("9"))})
    return base.unionByName(later)


def import_pair_map(report: DataFrame, universe: DataFrame, exclude: Sequence[str] = ("DE",), beta: float = 1.0) -> DataFrame:
    """Report to map: active linkers outside the excluded countries, first row per linker.

    ``status`` is ``mapped``, ``unmatched`` (not in the active universe) or ``uncovered`` (active linker
    without a comparator).
    """
    rows = report.dropna(subset=["isin", "comparator_isin"]).withColumns({"real_id": F.trim("isin"), "nominal_id": F.trim("comparator_isin")})
    rows = rows.select("real_id", "nominal_id", F.concat_ws(" vs ", "issue", "comparator").alias("note"), "beta_1m", "beta_3m", "file_no")
    active = universe.where(~F.col("deferred")).select(F.col("bond_id").cast("string").alias("real_id"), "country")
    met = rows.join(active, "real_id", "left")
    kept = met.where(F.col("country").isNotNull() & ~F.col("country").isin(*exclude))
    mapped = first_in_order(kept.drop("country"), ["real_id"], [F.col("file_no")]).drop("file_no")
    mapped = mapped.select(F.lit("mapped").alias("status"), "real_id", "nominal_id", F.lit(beta).alias("beta"), "note", "beta_1m", "beta_3m")
    blank = lambda df, s: df.select(F.lit(s).alias("status"), "real_id", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("nominal_id", "string"), ("beta", "double"), ("note", "string"), ("beta_1m", "double"), ("beta_3m", "double"))])
    unmatched = blank(met.where(F.col("country").isNull()).select("real_id").distinct(), "unmatched")
    uncovered = blank(active.where(~F.col("country").isin(*exclude)).join(mapped.select("real_id"), "real_id", "left_anti"), "uncovered")
    return mapped.unionByName(unmatched).unionByName(uncovered)


# ------------------------------------------------------------------ exported bond lists
ISIN_SHAPE = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
SERIAL_BASE = "1899-12-30"
SERIAL_LO, SERIAL_HI, NUMERIC_SHARE, RANGE_SHARE = 8000, 95000, 0.7, 0.8  # fixed values
LINKER_MARKS = ["i ", "€i", "i/l", "ils"]  # fixed values: ticker fragments of linked bonds


def isin_of(k: Column, country: Column) -> Column:
    return F.concat(country, F.lpad(k.cast("string"), 10, "0"))


def bond_export(bonds: DataFrame) -> DataFrame:
    """Bond list as exported: one file with day serials, one with text dates, commas, junk ids, linkers, repeats."""
    k = F.col("bond_id")
    serial = lambda c: F.datediff(F.col(c), F.lit(SERIAL_BASE).cast("date")).cast("string")
    text = lambda c: F.col(c).cast("string")
    first_file = k % 4 < 2
    isin = F.when(k % 19 == 3, F.lit("ISIN n/a")).otherwise(F.concat(F.lit(" "), F.lower(isin_of(k, F.col("country")))))
    ticker = F.when(F.col("linked") & (k % 8 == 2), F.lit("BTPi ")).when(F.col("linked") & (k % 8 == 4), F.lit("OAT€i")).otherwise(F.lit("GOVT"))
    rows = bonds.select(
        F.when(first_file, "a.csv").otherwise("b.csv").alias("file"), isin.alias("isin"), F.format_string("%.2f", "coupon").alias("coupon"),
        F.when(k % 29 == 7, F.lit("")).otherwise(F.when(first_file, serial("maturity")).otherwise(text("maturity"))).alias("maturity"),
        F.when(first_file, serial("issue")).otherwise(text("issue")).alias("issue_date"), ticker.alias("ticker"),
        F.format_number(F.col("amt_issued"), 0).alias("amt_issued"), k.alias("line"),
    )
    return rows.unionByName(rows.where("line % 6 = 1").withColumn("line", F.col("line") + 1000000000))


def date_columns(raw: DataFrame, cols: Sequence[str], by: str = "file") -> DataFrame:
    """Text or serial dates, decided per file and column from a profile of all its rows.

    The profile is one aggregate row per file, joined back.
    """
    num = lambda c: F.trim(F.col(c)).try_cast("double")
    profile = raw.groupBy(by).agg(*[
        ((F.count(num(c)) / F.count(F.lit(1)) > NUMERIC_SHARE) & (F.count_if(num(c).between(SERIAL_LO, SERIAL_HI)) / F.count(num(c)) > RANGE_SHARE)).alias(f"__s_{c}")
        for c in cols
    ])
    day = lambda c: F.when(
        F.col(f"__s_{c}"), F.date_add(F.lit(SERIAL_BASE).cast("date"), F.round(num(c)).cast("int"))
    ).otherwise(F.trim(F.col(c)).try_cast("date"))
    return raw.join(profile, by).withColumns({c: day(c) for c in cols}).drop(*[f"__s_{c}" for c in cols])


def import_nominal_universe(raw: DataFrame, linkers: DataFrame, flagged: DataFrame, countries: Sequence[str] = tuple(cv.COUNTRIES)) -> DataFrame:
    """Clean list of nominal bonds: valid ids of known countries, no linkers by id, ticker or flag, dated, first per id.

    ``linkers`` and ``flagged`` are ``isin`` frames.
    """
    dated = date_columns(raw, ["maturity", "issue_date"])
    shaped = dated.withColumns(
        {"isin": F.upper(F.trim("isin")), "coupon": F.col("coupon").try_cast("double"), "ticker": F.trim("ticker"), "mark": F.lower(F.trim("ticker")),
         "amt_issued": F.regexp_replace("amt_issued", ",", "").try_cast("double")}
    ).where(F.col("isin").rlike(ISIN_SHAPE))
    shaped = shaped.withColumn("country", F.substring("isin", 1, 2)).where(F.col("country").isin(*countries))
    clean = shaped.join(linkers, "isin", "left_anti").join(flagged, "isin", "left_anti")
    for mark in LINKER_MARKS:
        clean = clean.where(~F.col("mark").contains(mark))
    known = clean.where(F.col("maturity").isNotNull()).select("isin", "coupon", "maturity", "issue_date", "ticker", "amt_issued", "country", "file", "line")
    return first_in_order(known, ["isin"], [F.col("file"), F.col("line")]).drop("file", "line")


# ------------------------------------------------------------------ debt-office operation lines
FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875, "⅓": 1 / 3, "⅔": 2 / 3}  # fixed values


def operation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation-result lines written from the orders on the block's linked bond."""
    from . import driver_tables as src

    o = src.orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_totalprice")
    o = o.withColumn("bond_id", F.expr("(o_custkey div 30) * 2")).join(src.bonds(spark, sf_dir).where("linked"), "bond_id")
    k = F.col("o_orderkey")
    whole, quarter = F.floor("coupon").cast("int"), (F.col("coupon") % 1 * 4).cast("int")
    mixed = lambda marks: F.when(quarter == 0, whole.cast("string")).otherwise(
        F.concat(F.when(whole > 0, F.concat(whole.cast("string"), F.lit(" "))).otherwise(""), F.element_at(F.array(*[F.lit(m) for m in marks]), F.greatest(quarter, F.lit(1)))))
    coupon = F.when(k % 3 == 0, F.format_string("%.2f%%", F.col("coupon"))).when(k % 3 == 1, F.concat(F.regexp_replace(mixed("¼½¾"), " ", ""), F.lit("%"))).otherwise(
        F.concat(mixed(["1/4", "1/2", "3/4"]), F.lit("%")))
    kind = F.when(k % 11 == 4, "Conventional").otherwise("Index-linked Treasury")
    paper = F.when(k % 13 == 6, "Stock").otherwise("Gilt")
    amount = F.when(k % 7 == 5, F.lit("")).otherwise(F.concat(F.lit(" "), F.format_number(F.col("o_totalprice") / 100, 4), F.lit(" 1.85")))
    method = F.element_at(F.array(F.lit("Auction"), F.lit("Tender"), F.lit("Syndication")), (k % 3 + 1).cast("int"))
    line = F.concat(F.date_format("date", "d-MMM-yyyy"), F.lit(" "), coupon, F.lit(" "), kind, F.lit(" "), paper, F.lit(" "), F.year("maturity").cast("string"), amount, F.lit(" "), method)
    return o.select(line.alias("value"))


def parse_coupon(text: Column) -> Column:
    """Decimal, ``n/m``, whole with either, or a unicode fraction."""
    bare = F.trim(F.regexp_replace(text, "%", ""))
    for mark, value in FRACTIONS.items():
        bare = F.regexp_replace(bare, f"\\s*{mark}", f" +{value!r}")
    frac = F.regexp_extract(bare, r"(\d+)/(\d+)$", 1).try_cast("double") / F.regexp_extract(bare, r"(\d+)/(\d+)$", 2).try_cast("double")
    plus = F.regexp_extract(bare, r"\+([0-9.]+)$", 1).try_cast("double")
    whole = F.regexp_extract(bare, r"^([0-9.]+)(?=$| )", 1).try_cast("double")
    return F.round(F.coalesce(whole, F.lit(0.0)) + F.coalesce(frac, plus, F.lit(0.0)), 4)


def parse_gilt_ops(lines: DataFrame, universe: DataFrame) -> DataFrame:
    """Executed index-linked operations mapped to bonds by coupon and maturity year.

    One event per bond and day; the first sale of a bond is new, the rest reopen it. ``universe`` has
    bond_id, coupon and maturity; a (coupon, year) shared by several bonds maps to the smallest id.
    """
    v = F.col("value")
    wanted = lines.where(F.lower(v).contains("index-linked") & v.rlike(r"(?i)index-linked.*\bGilt \d{4}\b"))
    parsed = wanted.select(
        F.to_date(F.regexp_extract(v, r"(?:^|\s)(\d{1,2}-[A-Za-z]{3}-\d{4})(?:\s|$)", 1), "d-MMM-yyyy").alias("event_date"),
        parse_coupon(F.regexp_extract(v, r"(?i)(?:^|\s)((?:[\d/¼½¾⅛⅜⅝⅞⅓⅔.]+%? )+)index-linked", 1)).alias("coupon"),
        F.regexp_extract(v, r"\bGilt (\d{4})\b", 1).try_cast("int").alias("mat_year"),
        F.regexp_replace(F.regexp_extract(v, r"\bGilt \d{4}\b.*?\s([\d,]+\.\d+)(?:\s|$)", 1), ",", "").try_cast("double").alias("amt_mn"),
        F.when(v.contains("Syndication"), "syndication").when(v.contains("Tender"), "tender").otherwise("auction").alias("method"),
    ).where(F.col("event_date").isNotNull() & F.col("amt_mn").isNotNull())
    ids = universe.groupBy(F.round("coupon", 4).alias("coupon"), F.year("maturity").alias("mat_year")).agg(F.min("bond_id").alias("bond_id"))
    ops = parsed.join(ids, ["coupon", "mat_year"])
    once = first_in_order(ops.select("bond_id", "event_date", "amt_mn", "method"), ["bond_id", "event_date"], [F.col("amt_mn"), F.col("method")])
    first = F.min("event_date").over(Window.partitionBy("bond_id"))
    tagged = once.withColumn("reopening", F.col("event_date") != first)
    return tagged.select("bond_id", "event_date", F.when(F.col("reopening"), "reopening").otherwise(F.col("method")).alias("event_type"),
                         F.round(F.col("amt_mn") * 1e6, 0).alias("amount"), "reopening")


# ------------------------------------------------------------------ tap files
TAP_COLUMNS = {"isin": "string", "event_date": "date", "settle_date": "date", "event_type": "string", "amount": "double", "price": "double",
               "yield": "double", "reopening": "boolean"}  # fixed values: the canonical columns


def scan_tap_files(spark: SparkSession, files: Sequence[str], markets: DataFrame) -> DataFrame:
    """Tap CSVs, one file (or folder of parts) per country named by its stem.

    Each keeps its own header; canonical columns it lacks are null; the market comes by bond. The
    list is one entry per debt office.
    """
    out = None
    for path in files:
        raw = spark.read.option("header", True).csv(path)
        cells = [(F.col(c).try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in TAP_COLUMNS.items()]
        country = path.rstrip("/").rsplit("/", 1)[-1].split(".")[0].upper()
        part = raw.select(*cells, F.lit(country).alias("country"), F.lit("dmo").alias("source"))
        out = part if out is None else out.unionByName(part)
    return out.join(markets.select("isin", "market"), "isin", "left")


def tap_file_round_trip(spark: SparkSession, taps: DataFrame) -> DataFrame:
    """Land the taps as CSVs per country, the British ones without an event type, and scan them back."""
    from ..session import Landing

    root = Landing(spark).root
    rows = taps.select(isin_of(F.col("bond_id"), F.col("country")).alias("isin"), "event_date", F.lit("tap").alias("event_type"), "amount",
                       F.lit(True).alias("reopening"), "country", "market")
    files = []
    for country in cv.COUNTRIES:
        cols = ["isin", "event_date", "event_type", "amount", "reopening"]
        files.append(f"{root}/{country.lower()}.csv")
        rows.where(F.col("country") == country).select(*[c for c in cols if country != "GB" or c != "event_type"]).write.option("header", True).csv(files[-1])
    return scan_tap_files(spark, files, rows.select("isin", "market").distinct())


def round_trip_mart(spark: SparkSession, mart: DataFrame) -> DataFrame:
    """Publish a mart and read both of its copies back, with the ``format`` of each."""
    from ..session import Landing
    from .marts import FORMATS, Mart

    published = Mart(spark, Landing(spark).root)
    published.publish(mart)
    copies = [published.read(f).withColumn("format", F.lit(f)) for f in FORMATS]
    return copies[0].unionByName(copies[1])


PAIR_COLUMNS = ["real_id", "nominal_id", "beta", "note"]


def read_pair_map(spark: SparkSession, path: str, columns: list[str] = PAIR_COLUMNS) -> DataFrame:
    """A hand-kept map from a file or a folder of CSV files, as text columns: found by name in each file's own header, null where a file lacks one.

    What follows a ``#`` outside quotes is a comment; blank lines and empty cells count as nothing. The header of a file is its line with the first two
    names of ``columns``; a file without one gives no row. A missing folder gives an empty frame.
    """
    kind = ", ".join(f"`{c}` string" for c in columns)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], kind)
    plain = F.trim(F.regexp_replace("value", r'^((?:[^"#]|"[^"]*")*)#.*$', "$1"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), plain.alias("line")).where("line <> ''")
    width = lines.agg(F.max(F.size(F.split("line", ",")))).first()[0] or 1
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)))
    parsed = lines.select("file", F.transform(F.array(*[cells[f"c{i}"] for i in range(width)]), lambda c: F.trim(c)).alias("cells"))
    is_header = F.array_contains("cells", columns[0]) & F.array_contains("cells", columns[1])
    headers = parsed.where(is_header).groupBy("file").agg(F.first("cells").alias("names"))  # a row a file
    rows = parsed.where(~F.coalesce(is_header, F.lit(False))).join(headers, "file")
    cell = lambda c: F.when(F.array_contains("names", c), F.get("cells", F.array_position("names", c).cast("int") - 1))
    return rows.select(*[F.nullif(cell(c), F.lit("")).alias(c) for c in columns])


def pair_map_round_trip(spark: SparkSession, pair_map: DataFrame) -> DataFrame:
    """The map as three files of different columns, orders and comments, read back as one."""
    from ..session import Landing

    root = Landing(spark).root
    text = pair_map.select(F.col("real_id").cast("string"), F.col("nominal_id").cast("string"), F.col("beta").cast("string"), "note")
    shapes = [(0, ["real_id", "nominal_id", "beta", "note"], "# kept by hand"), (1, ["note", "nominal_id", "real_id"], "# no ratios here"), (2, ["beta", "real_id", "desk", "nominal_id"], "#")]
    for turn, names, remark in shapes:
        own = text.where(F.col("real_id") % 3 == turn).withColumn("desk", F.lit("a, b # c"))
        quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"')) if c in ("note", "desk") else F.col(c)
        body = own.select(F.concat_ws(",", *[F.coalesce(quoted(c), F.lit("")) for c in names]).alias("value"))
        head = spark.createDataFrame([(remark,), (",".join(names),), ("",)], "value string")
        head.union(body.withColumn("value", F.concat("value", F.lit("  # checked")))).coalesce(1).write.mode("append").text(root)
    return read_pair_map(spark, root)
