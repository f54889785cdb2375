"""Materialized views: a query's text kept, its rows written as a table."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from ..functions.values import QueryError
from ..lang.parser import parse

DEFINITIONS = "__views"


def create(engine, tree, text: str, binds: dict | None) -> DataFrame:
    body = re.sub(r"^\s*CREATE\s+MATERIALIZED\s+VIEW\s+\S+\s+AS\s+", "", text, flags=re.IGNORECASE)
    catalog = engine.catalog
    catalog.views[tree.create_view] = json.dumps({"query": body, "binds": binds or {}})
    rows = list(catalog.views.items())
    catalog.replace(DEFINITIONS, engine.spark.createDataFrame(rows, "name string, definition string"))
    return catalog.replace(tree.create_view, engine.query(body, binds))


def definition(engine, name: str) -> dict:
    catalog = engine.catalog
    if name not in catalog.views and catalog.has(DEFINITIONS):
        catalog.views.update({r.name: r.definition for r in catalog.table(DEFINITIONS).collect()})
    if name not in catalog.views:
        raise QueryError(f"no view {name}")
    return json.loads(catalog.views[name])


def refresh(engine, name: str) -> DataFrame:
    """Runs the kept query again. The new rows are a new version, so the query may read the view itself."""
    kept = definition(engine, name)
    parse(kept["query"])
    return engine.catalog.replace(name, engine.query(kept["query"], kept["binds"]))
