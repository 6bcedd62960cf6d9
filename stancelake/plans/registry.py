"""All registered queries of the library proper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Adds a query, and its oracle where SQL can express it."""

    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return keep


def _load() -> None:
    import importlib

    for name in ("boards", "series", "text", "ingest", "evaluation", "retrieval", "speeches", "asof", "sources", "views"):
        importlib.import_module(f"stancelake.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
