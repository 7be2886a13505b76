"""The queries of the engine's own operators, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import bundles, contracts, corpus, evaluation, files, graphs, presentation, records, retrieval, selection
from lodestrata.session import ship

MODULES = (retrieval, corpus, evaluation, graphs, selection, presentation, contracts, bundles, records, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()} | {"stance_classification": graphs.STANCE_CLASSIFICATION}
