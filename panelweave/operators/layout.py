"""Storing a panel in the layout that questions about its entities need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.spread import CHUNK, separate_heavy, total_order
from panelweave.sources.workspace import default_buckets, pin_bucketed


def store_by_entity(
    df: DataFrame, entity: str, period: str, key: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of whole entities, and return the written table.

    Operators that group by entity, or have windows over it, read the stored rows without an exchange, however
    many of them ask; so do joins on the entity, and no further key, of two panels stored with the same number
    of ``buckets`` (``spark.sql.shuffle.partitions`` by default). It pays from the second question on, since storing is one exchange.

    Each file is sorted by entity, period and ``key``. Entities with few rows are shuffled, so that a bucket is one
    file; those above ``spark.panelweave.rowsPerChunk`` are cut into ranges and written by several tasks, as several
    files of their bucket. NULL is an entity as any other. Rows and columns stay as they are; an empty table gives an
    empty one. ``scope`` and ``release`` delete the table.
    """
    buckets = buckets or default_buckets(df.sparkSession)
    columns = df.columns
    ordered, order = total_order(df, period, key)
    light, heavy = separate_heavy(ordered, [entity], order)
    parts = []
    if light is not None:
        parts.append(light.select(*map(_named, columns)).repartition(buckets, _named(entity)))
    if heavy is not None:
        parts.append(heavy.drop(CHUNK).select(*map(_named, columns)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return pin_bucketed(rows, [entity], [period] if key is None else [period, key], buckets)


def _named(column: str):
    return F.col(f"`{column}`")
