"""All catalog queries by name, with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnlake.plans.fixtures import FIXTURES, Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A request path with its ids replaced, in DuckDB.
PATH_SQL = r"'/' || array_to_string(list_transform(string_split(trim(regexp_replace(path, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', ':uuid', 'g'), '/'), '/'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN ':id' ELSE x END), '/')"


def query(sql: str | None = None, fixtures: bool = True):
    """Registers a function of a ``Lake`` under its name; ``sql`` follows the fixture CTEs."""

    def add(f: Callable[[Lake], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Lake(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = (FIXTURES if fixtures else "") + sql
        return f

    return add


from cairnlake.plans import catalog, flows, formats, lifecycle, scalars, upkeep  # noqa: E402, F401
