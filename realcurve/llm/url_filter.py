"""URL filters by a sort-merge range join of reversed-host keys.

A url ``scheme://a.b.c/path`` has one canonical key per host suffix (``c``, ``c.b``, ``c.b.a``, each followed by the path), and a rule
``b.c/prefix`` is the interval of all keys that start with ``c.b`` and the prefix. Intervals of prefixes nest or are disjoint, so over
the sorted keys a running sum of starts and ends is the height of the stack of active rules, and the rule on top is the last start at
that height. Keys are cut into ranges by a sample of them; rules that reach into a range are copied to its begin, so every range is
swept by itself. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_below, slots, table

#: Rules of the query: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Between host and path of a key, and the end of an interval after its key: bytes that no text holds. Keys are bytes, in the order of their bytes.
CUT, LAST = b"\xfe", b"\xff"
#: Keys taken from the whole for each range, to choose the bounds of the ranges.
SAMPLE_PER_RANGE = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host.cast("binary"), F.lit(CUT), path.cast("binary"))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds ``host, path, rule, verdict`` to rows with a ``url``; columns of these names are replaced.

    ``rules`` has ``host, path, verdict``. A rule fits its host and every subdomain when the path starts with its path (an empty or null
    path: any path); the longest (host and path together, then host) wins, ``default`` holds where none fits. Of rules for the same host and
    path a block wins; rules with a null host are ignored. A null url has an empty host and path and gets the default. Repeated urls are
    judged once; every row is returned. Hosts may be long: only as many of their last labels are looked up as the longest rule has.
    """
    spark = urls.sparkSession
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    rules = (
        rules.where("host is not null")
        .select(_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
        .select(_key(F.array_join(_reversed(F.col("host")), "."), F.col("path")).alias("key"), F.size(_reversed(F.col("host"))).alias("labels"), F.concat("host", "path").alias("rule"),
                F.struct(F.length(F.concat("host", "path")).alias("long"), F.length("host").alias("host_long")).alias("rank"), "verdict")
    )
    parts = urls.select("url").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels = _reversed(F.col("host"))
    most = rules.agg(F.max("labels")).first()[0] or 1
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    keys = parts.select("url", "path", F.explode(suffixes).alias("suffix")).select("url", _key(F.col("suffix"), F.col("path")).alias("key"))
    swept = _sweep(spark, keys.select("key").distinct(), rules)
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("rank", "rule", "verdict"))).alias("best")
    found = keys.join(swept, "key").groupBy("url").agg(best).select(F.col("url").alias("url_"), "best")
    return (
        urls.select(*own).join(found, F.col("url").eqNullSafe(F.col("url_")), "left")
        .select(*own, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"),
                F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def _sweep(spark: SparkSession, keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``key`` with the ``rank, rule, verdict`` of the longest rule whose key is a prefix of it, null without one."""
    ranges = max(1, slots(spark))
    sample = sorted(r["key"] for r in keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_PER_RANGE * ranges).collect())
    bounds = sorted(set(sample[:: max(1, len(sample) // (4 * ranges))]))
    place = lambda c: count_below(bounds, c)
    end = F.concat("key", F.lit(LAST))
    held = rules.withColumn("end", end).withColumn("at", F.explode(F.sequence(place(F.col("key")), place(F.col("end")))))
    # at one position: ends before starts, outer starts before inner ones, keys last
    starts = held.select("at", F.col("key").alias("pos"), F.lit(1).alias("step"), F.struct("rank", "rule", "verdict").alias("top"))
    ends = held.where(place(F.col("end")) == F.col("at")).select("at", F.col("end").alias("pos"), F.lit(-1).alias("step"), F.lit(None).cast(starts.schema["top"].dataType).alias("top"))
    asked = keys.select(place(F.col("key")).alias("at"), F.col("key").alias("pos"), F.lit(0).alias("step"), F.lit(None).cast(starts.schema["top"].dataType).alias("top"))
    order = [F.col("pos"), F.when(F.col("step") == -1, 0).when(F.col("step") == 1, 1).otherwise(2)]
    so_far = (Window.unboundedPreceding, Window.currentRow)
    events = starts.union(ends).union(asked)
    stacked = events.withColumn("height", F.sum("step").over(Window.partitionBy("at").orderBy(*order).rowsBetween(*so_far)))
    topped = stacked.withColumn("active", F.last("top", ignorenulls=True).over(Window.partitionBy("at", "height").orderBy(*order).rowsBetween(*so_far)))
    active = F.when(F.col("height") > 0, F.col("active"))
    return topped.where("step = 0").select(F.col("pos").alias("key"), active["rank"].alias("rank"), active["rule"].alias("rule"), active["verdict"].alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by ``RULES``; urls that no rule fits are allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'),
                                           ('com','/fr/','allow'), ('com','/de/','block')),
cut AS (SELECT page_id, url, strpos(url, '://') AS p FROM pages),
rest AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM cut),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
         FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
