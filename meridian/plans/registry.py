"""Registry of named queries and their DuckDB oracle twins.

A query builder takes a :class:`~meridian.sources.bindings.Bindings` and
returns a lazy DataFrame.  ``register`` records the builder and, when given,
the oracle SQL (composed from ``oracle_views``).  Registration order is kept so
lineage/catalog operators can enumerate the products.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame

from .oracle_views import compose

Builder = Callable[..., DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
INPUTS: dict[str, tuple[str, ...]] = {}
_ORACLE_SPEC: dict[str, tuple[str, tuple[str, ...]]] = {}


def register(name: str, sql: str | None = None, deps: tuple[str, ...] = (), inputs: tuple[str, ...] = ()):
    """Decorator: register ``fn(b) -> DataFrame`` under ``name``.

    ``sql`` is the final SELECT of the oracle; ``deps`` are oracle views it
    needs; ``inputs`` are upstream products (for the lineage catalog).
    """

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            _ORACLE_SPEC[name] = (sql, tuple(deps))
        INPUTS[name] = tuple(inputs)
        return fn

    return deco


def stored_first(fn: Builder) -> Builder:
    """Decorator for a product of the core layer: the stored table if the
    bindings have one, else the product's plan."""

    @wraps(fn)
    def run(b) -> DataFrame:
        found = b.stored.get(fn.__name__)
        return fn(b) if found is None else found

    return run


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (core, staging, operators_q, product, growth, growth_lifecycle, finance, finance_ops, terminal,  # noqa: F401
                   semantic_q, quality_q, catalog_q, reports, streaming_q, ingest_q)
    for name, (sql, deps) in _ORACLE_SPEC.items():
        if name not in ORACLE:
            ORACLE[name] = compose(sql, *deps)
