"""A SELECT over a stream: the same plan, with the collection replaced by a streaming table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..catalog import Collection
from ..engine import Engine


def watch(engine: Engine, collection: str, stream: DataFrame, text: str) -> DataFrame:
    """The streaming rows of a SELECT whose FROM names ``collection``.

    Filters, projections, references into static collections and grouped aggregates work; give a watermark
    to ``stream`` to bound an aggregate's state.  Write the result with ``writeStream`` (append for plain
    rows, update or complete for aggregates).
    """
    catalog = engine.catalog.copy()
    old = catalog.collections.get(collection)
    catalog.collections[collection] = Collection(collection, stream, dict(old.refs) if old else {})
    return Engine(engine.spark, catalog).query(text)
