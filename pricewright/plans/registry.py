"""The registered queries: a function over the domain views and the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricewright.sources.domain import Domain, checking_views

QUERIES: dict[str, tuple[Callable[[Domain], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers a query. ``sql`` may use the domain views by name, and may begin with tables of its own."""

    def add(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = (build, sql)
        return build

    return add


def _load() -> None:
    from pricewright.plans import catalog, consensus, households, imports, matching, prices, pricing, receipts, recipes, resolution, shopping, streams, upserts, worklists  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, folder, build=build: build(Domain(spark, folder))) for name, (build, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    views = checking_views()
    out = {}
    for name, (_, sql) in QUERIES.items():
        if sql:
            body = sql.strip()
            out[name] = f"WITH RECURSIVE {views}" + ("\n" if body.upper().startswith("SELECT") else ",\n") + body
    return out


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Basket prices over all stores."""
    return queries()["opt01_basket_over_stores"](spark, folder)
