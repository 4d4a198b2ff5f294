"""Correlation of measures, overall and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.moments import centred_correlation, pairwise_correlation


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], pairwise: bool = False) -> DataFrame:
    """One row with ``corr_<x>_<y>`` per pair, from a single scan."""
    return df.agg(*_coefficients(pairs, pairwise))


def pearson_by_group(
    df: DataFrame, group: str, pairs: Sequence[tuple[str, str]], pairwise: bool = False
) -> DataFrame:
    """As :func:`pearson`, with each variable centred on its mean within the group."""
    return df.groupBy(group).agg(*_coefficients(pairs, pairwise))


def _coefficients(pairs: Sequence[tuple[str, str]], pairwise: bool) -> list[Column]:
    coefficient = pairwise_correlation if pairwise else centred_correlation
    return [
        coefficient(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"corr_{x}_{y}")
        for x, y in pairs
    ]
