"""An analyst's query: on what they may see, to where results belong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirline.operators.governance import AccessRules, govern
from weirline.plans.governed import run_governed
from weirline.sinks import ResultStore


def answer(
    spark: SparkSession,
    rules: AccessRules,
    principal: str,
    table: str | None,
    query: Callable[[DataFrame], DataFrame] | str,
    store: ResultStore,
    name: str,
) -> str:
    """Run ``query`` on governed tables and give the location of its result.

    A query is a function of the governed ``table``, or SQL text. Text may name any
    tables, each seen as its reader may see it; ``table`` also goes by its last name there.
    """
    if callable(query):
        if table is None:
            raise ValueError("a function needs a table to work on")
        return store.write(query(govern(spark, rules, principal, table)), name)
    names = {table.rsplit(".", 1)[-1].lower(): table} if table else {}
    return store.write(run_governed(spark, rules, principal, query, names), name)
