"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("q01_quality", "q02_lm", "q03_mixture", "q04_telephony", "q05_simhash", "q06_toxicity", "q07_decontamination", "q08_licences", "q09_chat", "q10_html", "q11_lines", "q12_clusters", "q13_search")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"stancelake.llm.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
