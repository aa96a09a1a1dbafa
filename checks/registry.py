"""Case registration: one output spec drives both sides.

A spec is a list of columns: ``name`` as is, ``name:4`` rounded to 4 decimals, ``name:d`` a date shown
as text, ``name:i`` an integer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from realcurve.plans.panel import Panel

from .ctes import expand

CASES: dict[str, "Case"] = {}
_PANELS: dict[tuple[str, str], Panel] = {}


def panel(spark: SparkSession, sf_dir: str, fresh: bool = False) -> Panel:
    """The panel of a folder; queries of one application share its landed calendar-sized tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if fresh or key not in _PANELS:
        _PANELS[key] = Panel(spark, sf_dir)
    return _PANELS[key]


@dataclass(frozen=True)
class Case:
    name: str
    spec: tuple[tuple[str, str], ...]
    build: Callable[[Panel], DataFrame]
    sql: str | None

    def spark(self, spark: SparkSession, sf_dir: str, fresh: bool = False) -> DataFrame:
        return shaped(self.build(panel(spark, sf_dir, fresh)), self.spec)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return expand(f"SELECT {', '.join(_sql(c, k) for c, k in self.spec)} FROM ({self.sql}) shown")


def _sql(c: str, kind: str) -> str:
    name = f'"{c}"'
    if kind == "d":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind:
        return f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}"
    return name


def shaped(df: DataFrame, spec) -> DataFrame:
    cols = []
    for c, kind in spec:
        col = F.col(c)
        if kind == "d":
            col = col.cast("string")
        elif kind == "i":
            col = col.cast("bigint")
        elif kind:
            col = F.round(col.cast("double"), int(kind)) + F.lit(0.0)
        cols.append(col.alias(c))
    return df.select(*cols)


def case(name: str, spec: str, build: Callable[[Panel], DataFrame], sql: str | None = None) -> None:
    if name in CASES:
        raise ValueError(f"duplicate case {name}")
    parsed = tuple((c, k) for c, _, k in (item.partition(":") for item in spec.split()))
    CASES[name] = Case(name, parsed, build, sql)
