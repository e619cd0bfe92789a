"""SQL text per registered query."""

import oracle.flows  # noqa: F401
import oracle.hosts  # noqa: F401,I001
import oracle.findings  # noqa: F401,I001
import oracle.graph  # noqa: F401
import oracle.timeline  # noqa: F401,I001
import oracle.catalog  # noqa: F401,I001
from netloom.plans import pipeline
from netloom.plans.queries import ARTIFACTS, TABLES
from oracle import special
from oracle.base import closure


def _select(table: str, columns: list[str]) -> str:
    items = [f"coalesce(array_to_string({c[1:]}, ','), '') AS {c[1:]}" if c.startswith("@") else c for c in columns]
    return closure(f"SELECT {', '.join(items)} FROM {table.replace('.', '_')}")


SQL = {name: _select(*spec) for name, spec in TABLES.items()} | {name: closure(sql) for name, sql in special.SQL.items()}
# an artifact has the columns of a query, over the table that it is written from
SQL |= {name: _select(pipeline.ARTIFACTS[artifact], TABLES[slug][1]) for name, (_, artifact, slug) in ARTIFACTS.items()}
