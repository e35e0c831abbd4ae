"""Registered queries: a Spark plan and (where SQL can say it) a DuckDB twin.

Each entry reads the driver tables of one ``sf_dir`` — directly or through
the reference tables ``Catalog`` derives from them — so its work grows with
the data.  ``oracle`` is ANSI SQL over the same Parquet (driver tables are
views; reference tables are CTEs from ``fixture_sql``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlens.plans.fixture_sql import with_tables
from leadlens.session import ensure_checkpoint_dir
from leadlens.sources.tables import Catalog


@dataclass
class Query:
    name: str
    build: Callable[[Catalog], DataFrame]
    oracle: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, tables: tuple = ()):
    """Decorator: add ``fn(catalog) -> DataFrame`` under ``name``."""
    def deco(fn):
        sql = with_tables(oracle, *tables) if oracle else None
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def spark_callable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # day buckets of TIMESTAMP casts (streaming forms, display ages) assume UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ensure_checkpoint_dir(spark)
        return q.build(Catalog(spark, sf_dir))
    run.__name__ = name
    run.__doc__ = q.doc
    return run


def load_all() -> dict[str, Query]:
    """Import every module that registers queries."""
    from leadlens.plans import dashboard, sink_jobs, store_jobs, table_jobs, text_jobs  # noqa: F401
    return REGISTRY
