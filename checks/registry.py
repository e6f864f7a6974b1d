"""Collects registered queries; a query without SQL is checked by pytest only."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Check(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        if name in CHECKS:
            raise ValueError(f"duplicate query {name}")
        CHECKS[name] = Check(fn, sql)
        return fn

    return register


def with_ctes(*ctes: str, select: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(ctes) + " " + select
