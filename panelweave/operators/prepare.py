"""Renaming, typing, correcting and deriving columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.scalars import blank_as_null, ratio, round_half_up, zero_as_null


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename several columns at once, so that one may take a name that another gives up."""
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"no such column: {absent}")
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def blank_to_null(
    df: DataFrame, columns: Sequence[str], trim: bool = False, zero_is_missing: bool = False
) -> DataFrame:
    """Turn the empty string into NULL in all ``columns`` in one pass.

    With ``trim`` a text of spaces counts as empty, and with ``zero_is_missing`` a number zero.
    """
    cleaned = {}
    for c in columns:
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.StringType):
            cleaned[c] = blank_as_null(c, trim)
        elif zero_is_missing and isinstance(dtype, T.NumericType):
            cleaned[c] = zero_as_null(F.col(f"`{c}`"))
    return df.withColumns(cleaned)


def cast_measures(df: DataFrame, types: Mapping[str, T.DataType | str]) -> DataFrame:
    """Give columns their types. Text that does not fit becomes NULL; see :func:`cast_failures`.

    A column that does not exist yet is added, filled with NULL.
    """
    return df.withColumns(
        {
            c: (F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t))
            for c, t in types.items()
        }
    )


def cast_failures(df: DataFrame, types: Mapping[str, T.DataType | str]) -> DataFrame:
    """One row: per column, how many non-blank values :func:`cast_measures` would lose."""
    return df.agg(
        *[
            F.count(F.when(F.col(c).try_cast(t).isNull(), blank_as_null(c))).alias(c)
            for c, t in types.items()
        ]
    )


def apply_corrections(
    df: DataFrame,
    fixes: DataFrame,
    key: str,
    updates: Mapping[str, Column | str],
    when: Column | str | None = None,
    only_null: bool = False,
) -> DataFrame:
    """Update ``df`` from the rows of ``fixes`` with the same ``key``; other rows stay as they are.

    The columns of ``fixes`` are visible to ``updates`` and ``when`` with the prefix ``fix_``.
    ``only_null`` touches only cells that are NULL. A key that occurs twice in ``fixes`` fails the
    job. For a fix computed from ``df`` itself, prefer the fill and repair operators: no join.
    """
    values = [c for c in fixes.columns if c != key]
    unique = fixes.groupBy(key).agg(
        *[F.any_value(c).alias(f"fix_{c}") for c in values], F.count(F.lit(1)).alias("_n")
    )
    repeated = F.raise_error(F.lit(f"fixes: {key} is not unique")).cast("boolean")
    unique = unique.withColumn("_matched", F.when(F.col("_n") > 1, repeated).otherwise(True))
    joined = df.join(unique.drop("_n"), key, "left")
    hit = F.col("_matched")
    if when is not None:
        hit = hit & (F.expr(when) if isinstance(when, str) else when)
    changes = {}
    for target, value in updates.items():
        value = F.expr(value) if isinstance(value, str) else value
        cell_hit = hit & F.col(target).isNull() if only_null else hit
        changes[target] = F.when(cell_hit, value.cast(df.schema[target].dataType)).otherwise(
            F.col(target)
        )
    # One projection, so that every update sees the rows as they were.
    return joined.withColumns(changes).select(*df.columns)


def delete_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Remove the rows whose ``key`` occurs in ``keys``."""
    return df.join(keys.select(key), key, "left_anti")


def derive_ratio(
    df: DataFrame,
    num: str,
    den: str,
    out: str,
    digits: int = 2,
    factor: float = 100.0,
    largest: float | None = 99.99,
) -> DataFrame:
    """Add ``out`` = num / den * factor, rounded; NULL for a zero divisor.

    With ``largest``, ``<out>_overflow`` marks values that a column of that range cannot hold.
    """
    value = ratio(F.col(num).cast("double"), F.col(den).cast("double")) * F.lit(factor)
    df = df.withColumn(out, round_half_up(value, digits))
    if largest is not None:
        df = df.withColumn(f"{out}_overflow", F.abs(F.col(out)) > F.lit(largest))
    return df
