"""The query catalog: operator id -> Spark job and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans.oracle_views import with_views
from riskloom.plans.testbed import Testbed

Job = Callable[[Testbed], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.jobs: dict[str, Job] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, job: Job, sql: str | None = None) -> None:
        if name in self.jobs:
            raise ValueError(f"query {name} is registered twice")
        self.jobs[name] = job
        if sql is not None:
            self.sql[name] = with_views(sql)


def load() -> Catalog:
    from riskloom.plans import (
        catalog_corpus, catalog_evaluation, catalog_exports, catalog_feedback, catalog_models,
        catalog_streams, catalog_text, catalog_visitors,
    )

    catalog = Catalog()
    for module in (
        catalog_text, catalog_feedback, catalog_evaluation, catalog_visitors, catalog_corpus, catalog_models,
        catalog_streams, catalog_exports,
    ):
        module.register(catalog)
    return catalog


def runner(job: Job) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: job(Testbed(spark, sf_dir))
