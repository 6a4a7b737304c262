"""Registry of the named queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.plans.bindings import Tables, prelude
from tallyboard.plans.rounding import DOUBLES, PLACES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = "", ctes: str = ""):
    """Register ``fn(tables)`` under ``name``.

    ``uses`` lists the views the SQL reads (see ``bindings.prelude``); ``ctes`` are
    further common table expressions placed between those views and ``sql``.
    """

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        doubles = DOUBLES.get(name, "").split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.withColumns({c: F.round(c, PLACES) for c in doubles}) if doubles else df

        QUERIES[name] = run
        if sql is not None:
            parts = [p for p in (prelude(uses.split()), ctes.strip().strip(",")) if p]
            whole = (f"with {', '.join(parts)} {sql}" if parts else sql).strip()
            if doubles:
                rounded = ", ".join(f'round("{c}", {PLACES}) as "{c}"' for c in doubles)
                whole = f"select * replace ({rounded}) from ({whole})"
            ORACLES[name] = whole
        return fn

    return keep
