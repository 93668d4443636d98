"""All registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from fairline.catalog import dataset, features, ingest, ledgers, markets, models, pricing, reports, streams, splits

    return (ingest, features, dataset, splits, pricing, ledgers, markets, reports, models, streams)


def queries() -> dict[str, Query]:
    return {name: q for m in _modules() for name, (q, _) in m.REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.REGISTRY.items() if sql}
