"""Layer materialisation: write a set of products as Parquet tables under the
shared checkpoint folder and hand back DataFrames that read them.

Downstream products built on the returned frames start from stored files, so a
lost executor costs a re-read of one stage instead of a recomputation of the
whole upstream lineage.  Fact tables are partitioned by month so that
month-filtered readers prune partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path
from ..sources import sinks
from .registry import QUERIES, load_all

# product -> partition columns of its stored table
CORE_LAYER: dict[str, tuple[str, ...]] = {
    "fct_sessions": ("session_month",),
    "fct_events": (),
    "dim_organizations": (),
    "fct_subscriptions": (),
    "fin_monthly_revenue": ("revenue_month",),
    "fin_subscription_history": (),
}


def materialize(b, names: dict[str, tuple[str, ...]] = CORE_LAYER, base: str | None = None) -> dict[str, DataFrame]:
    """Write each product and register its stored table with the bindings, so
    that later products, of this layer and above, read it."""
    load_all()
    base = (base or scratch_path(b.spark, "warehouse")).rstrip("/")
    for name, parts in names.items():
        b.stored[name] = sinks.materialize(QUERIES[name](b), name, "core", f"{base}/{name}", partition_by=parts)
    return {name: b.stored[name] for name in names}
