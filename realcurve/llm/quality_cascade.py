"""Quality rules as a short-circuit cascade.

Every text gets a few counts (words, symbols, repeated lines, repeated five-word windows). The rules that judge it form one ``CASE``
whose later branches are only evaluated for rows that all earlier ones let pass. In which order they stand is found on a sample: each
rule's cost is timed there, its rejections are counted together with those of all other rules, and the rule that rejects most of what is
still left per second comes next. The order decides how long the work takes and never which rows are kept: a row stays if no rule
rejects it.

Windows are counted within the row: hashes of all windows are sorted, only those that meet an equal neighbour are compared as words. So
nothing is shuffled and a document costs ``n log n`` of its own words.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Land, landing, table, words

#: The characters that count as symbols, the words of a window, the base limits.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 5, 10, 20
#: Documents of the sample on which the order is found, and how often each rule is timed.
SAMPLE_ROWS, ROUNDS = 2000, 2


@dataclass(frozen=True)
class Rule:
    """``rejects``: a column, never null, over ``__text``, ``__words``, ``__lines`` (lines with a word) and the counts of ``counted``."""

    name: str
    rejects: Column


def _share(array: str, test, percent: int, over: bool = True) -> Column:
    """Whether the elements that pass ``test`` are over (or under) ``percent`` of all."""
    found, all_ = 100 * F.size(F.filter(array, test)), percent * F.size(array)
    return found > all_ if over else found < all_


def rules() -> list[Rule]:
    """Limits as published for web text, wider where short clean texts need it."""
    return [
        Rule("few_letters", _share("__words", lambda w: w.rlike(r"\p{L}"), 40, over=False)),
        Rule("bullets", _share("__lines", lambda s: s.rlike(r"^[\x20\x09-\x0D]*[-*•]"), 90)),
        Rule("ellipses", _share("__lines", lambda s: s.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"), 30)),
        Rule("long_word", F.exists("__words", lambda w: F.length(w) > 1000)),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.size("__lines")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
    ]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once. Named in a projection of its own, it would be put in again for each use by a filter above."""
    return F.get(F.transform(F.array(value), use), 0)


def _twins(held: Column, key) -> Column:
    """The elements of a sorted array of which a neighbour has the same ``key``."""

    def twin(x: Column, k: Column) -> Column:
        return F.coalesce(key(F.get(held, k - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(held, k + 1)) == key(x), F.lit(False))

    return F.filter(held, twin)


def _repeated_words(held: Column) -> Column:
    """Words of ``held`` in windows that stand in it twice or more."""
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    any_twice = lambda s: F.exists(F.transform(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False))), lambda b: b)
    placed = lambda hashes: F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    written = lambda near: F.sort_array(F.transform(near, lambda x: F.struct(F.concat_ws(" ", F.slice(held, x["i"] + 1, WINDOW)).alias("h"), x["i"].alias("i"))))
    starts = lambda same: F.sort_array(F.transform(_twins(same, lambda x: x["h"]), lambda x: x["i"]))

    def covered(at: Column) -> Column:  # a window covers its words up to the next repeated window's start
        length = F.transform(at, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(length, F.lit(0).cast("long"), lambda a, n: a + n)

    def counted_in(hashes: Column) -> Column:
        exact = _let(_let(placed(hashes), lambda p: written(_twins(p, lambda x: x["h"]))), lambda same: _let(starts(same), covered))
        # most texts repeat no window: a plain sort of numbers tells
        return F.when(_let(F.sort_array(hashes), any_twice), exact).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(held) < WINDOW, F.lit(0).cast("long")).otherwise(_let(_let(F.transform(held, lambda w: F.xxhash64(w)), windows), counted_in))


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` (``text``) with its counts and what the rules read: ``__text, __words, __lines, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words``, the numbers as long. Columns of ``docs`` with these names are replaced."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.withColumns({"__text": text, "__words": words(F.col("text")), "__lines": F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))})
    return cut.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate("__text", "\t\n\x0b\x0c\r ", "")).cast("long"),
        "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _repeated_words(F.col("__words")),
    })


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def ordered(sample: DataFrame, held: list[Rule]) -> list[Rule]:
    """The rules by rejections per second among the rows of a small written ``sample`` that the rules before leave; ties and an empty sample by name.

    Only one row for each pattern of rejections reaches the driver, and one for each timing.
    """
    held = sorted(held, key=lambda r: r.name)
    read = [F.max(F.length("__text")), F.max(F.size("__words")), F.max(F.size("__lines")), F.max(sum((F.col(c) for c in ("word_chars", "n_symbols", "n_dup_lines")), F.col("n_words")))]

    def seconds(*more: Column) -> float:
        took = []
        for _ in range(ROUNDS):
            began = time.perf_counter()
            sample.agg(*read, *more).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    seconds()
    alone = seconds()
    cost = {r.name: max(1e-4, seconds(F.count_if(r.rejects)) - alone) for r in held}
    flags = sample.groupBy(*[r.rejects.alias(f"r{i}") for i, r in enumerate(held)]).count().collect()
    out, left = [], list(range(len(held)))
    while left:
        best = max(left, key=lambda i: (sum(f["count"] for f in flags if f[f"r{i}"]) / cost[held[i].name], -i))
        left.remove(best)
        out.append(held[best])
        flags = [f for f in flags if not f[f"r{best}"]]
    return out


def cascade(order: list[Rule]) -> Column:
    """The name of the first rule that rejects a row, null where none does; rules after it aren't evaluated."""
    found = F.lit(None).cast("string")
    for r in reversed(order):
        found = F.when(r.rejects, F.lit(r.name)).otherwise(found)
    return found


def judge(docs: DataFrame, land: Land, held: list[Rule] | None = None) -> DataFrame:
    """Every row of ``docs`` (``text``; all columns stay, those named like a result are replaced) with the counts, ``base_failed`` and ``kept``.

    A null text counts as empty and so fails the base, as every text of fewer than ten words does. Rows are judged one by one: repeated rows
    and rows with null ids or any other nulls have the same result as alone, and an empty table gives an empty one. Long texts are judged
    whole. The sample draws about ``SAMPLE_ROWS`` rows and only sets the order of the rules.
    """
    rows = docs.count()  # from the files' footers
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sample = land(counted(docs.select("text").sample(share, seed=7)))
    order = ordered(sample.where(~base_failed()), held if held is not None else rules())
    out = counted(docs).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(order).isNull()))
    return out.drop("__text", "__words", "__lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``."""
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), landing(spark))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT rid, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) AS w
  FROM cut WHERE len(words) >= 5),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid),
counts AS (
  SELECT rid, doc_id, words, lines, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * n_dup_lines > 30 * len(lines)
      OR len(list_filter(words, lambda w: length(w) > 1000)) > 0
      OR 100 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < 40 * len(words)
      OR 100 * len(list_filter(lines, lambda s: regexp_matches(s, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) > 90 * len(lines)
      OR 100 * len(list_filter(lines, lambda s: regexp_matches(s, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) > 30 * len(lines) AS rejected
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged"""
