"""Registry of named queries: a Spark builder and, where SQL can express it,
the DuckDB oracle text. ``__spark_entry__`` exposes both dicts.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the whole
driver tables of that directory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crewlens.plans.people import PeopleModel
from crewlens.sources.fixtures import Fixtures

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[..., DataFrame]) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    """Lazy views of one directory; made anew for each call, so results follow the files."""
    return Fixtures(spark, sf_dir)


def model(spark: SparkSession, sf_dir: str) -> PeopleModel:
    return PeopleModel.from_fixtures(Fixtures(spark, sf_dir))


def load_all() -> None:
    """Import every module that registers queries."""
    from crewlens.queries import (  # noqa: F401
        q_analysis,
        q_clean,
        q_feed,
        q_jobs,
        q_models,
        q_ninebox,
    )
