"""Ordered work within an entity, also when one entity holds a large share of all rows.

A window over ``entity`` sends all its rows to one task. :func:`split_heavy` counts rows per entity
first; only if some entity exceeds the limit are that entity's rows cut into contiguous ranges of
the window order, numbered by the column ``CHUNK`` (0 = not cut). :func:`in_parts` keeps them apart from
all other rows. The other functions give windows, whole-entity values and running totals that hold
across the cuts. Without a heavy entity they are plain windows and ``CHUNK`` does not exist.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.exact import (
    exact_totals,
    summed_pieces,
    with_pieces,
    with_totals,
    without_pieces,
)
from panelweave.sources.workspace import pin

CHUNK = "_chunk"
HALO = "_halo"
TIE = "_tie"

ROWS_PER_CHUNK = 2_000_000
ROWS_SETTING = "spark.panelweave.rowsPerChunk"


def rows_per_chunk(spark: SparkSession) -> int:
    """How many rows a group may hold and still go to one task, however many there are in all."""
    return int(spark.conf.get(ROWS_SETTING, str(ROWS_PER_CHUNK)))


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    also: Column | None = None,
) -> DataFrame:
    """Join on ``keys`` where NULL matches NULL; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True) if also is None else also
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"_right_{k}"])
    return left.join(right, condition, how).drop(*[f"_right_{k}" for k in keys])


def separate_heavy(
    df: DataFrame, by: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of ordinary groups, and those of groups with too many rows cut into ranges of ``order``.

    The second is a written table with ``CHUNK``, because every later read must see the same ranges;
    either is None if it has no rows to hold. Runs one counting job. ``order`` should be unique within the group, else
    rows with equal order stay together; names in it may be prefixed with ``-`` for descending.
    """
    heavy, limit = _heavy_groups(df, by)
    if heavy is None:
        return df, None
    pieces = -(-heavy.agg(F.sum("_n")).first()[0] // limit)
    hot, cold = _hot_and_cold(df, by, heavy)
    hot = hot.repartitionByRange(pieces, *by, *ordering(order))
    return cold, pin(hot.withColumn(CHUNK, F.spark_partition_id() + 1), "chunks")


def split_heavy(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Both parts of :func:`separate_heavy` as one table, where ordinary rows have ``CHUNK`` 0.

    ``df`` comes back unchanged if no group is heavy.
    """
    if is_split(df):
        return df
    cold, hot = separate_heavy(df, by, order)
    if hot is None:
        return df
    return hot if cold is None else cold.withColumn(CHUNK, F.lit(0)).unionByName(hot)


def total_order(df: DataFrame, period: str, key: str | None) -> tuple[DataFrame, list[str]]:
    """``df`` and an order of its rows by ``period``, in which only equal rows may tie.

    Without a ``key``, the column ``TIE``, a hash of the row, orders the rows of a period, so that they can
    be cut into ranges however many there are.
    """
    if key:
        return df, [period, key]
    return df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), [period, TIE]


def in_parts(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    step: Callable[[DataFrame], DataFrame],
    split: bool = True,
) -> DataFrame:
    """``step`` on ordinary groups as they are, and apart from them on heavy ones cut into ranges.

    A ``df`` that is split already, or that has no heavy group by ``split=False``, is one part.
    """
    if not split or is_split(df):
        return step(df)
    parts = [unsplit(step(part)) for part in separate_heavy(df, by, order) if part is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _heavy_groups(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame | None, int]:
    """Written table of the groups with too many rows, or None, and the limit they exceed."""
    sizes = _group_sizes(df, by)
    limit, largest = rows_per_chunk(df.sparkSession), _largest(sizes)
    if largest <= limit:
        return None, limit
    return pin(sizes.filter(F.col("_n") > limit), "heavy"), limit


def _hot_and_cold(
    df: DataFrame, by: Sequence[str], heavy: DataFrame
) -> tuple[DataFrame, DataFrame | None]:
    if not by:
        return df, None
    keys = heavy.drop("_n")
    return null_safe_join(df, keys, by, "left_semi"), null_safe_join(df, keys, by, "left_anti")


def has_heavy_group(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether some group of ``by`` has too many rows for one task. Runs one counting job."""
    return _largest(_group_sizes(df, by)) > rows_per_chunk(df.sparkSession)


def span_fits(df: DataFrame, column: str) -> bool:
    """Whether a whole-number ``column`` spans so few values that rows unique on a group and it
    cannot make the group heavy. Reads one column and needs no shuffle by group."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        return False
    low, high = df.agg(F.min(column), F.max(column)).first()
    # One more for NULL.
    return low is None or high - low + 2 <= rows_per_chunk(df.sparkSession)


def _group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))


def _largest(sizes: DataFrame) -> int:
    return sizes.agg(F.max("_n")).first()[0] or 0


def ordering(order: Sequence[str], reverse: bool = False) -> list[Column]:
    """Sort expressions for ``order``: NULL first ascending, NULL last descending."""
    return [
        F.col(c.lstrip("-")).desc() if c.startswith("-") != reverse else F.col(c.lstrip("-")).asc()
        for c in order
    ]


def is_split(df: DataFrame) -> bool:
    return CHUNK in df.columns


def unsplit(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK)


def group_window(df: DataFrame, by: Sequence[str]) -> WindowSpec:
    """Window over a whole group, or over one chunk of a split one."""
    return Window.partitionBy(*by, *([CHUNK] if is_split(df) else []))


def with_halo(
    df: DataFrame, by: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0
) -> DataFrame:
    """Add to each chunk copies of the rows just outside it, so that row frames reach across cuts.

    Copies have ``HALO`` true; remove them with :func:`without_halo` once the window is computed.
    """
    if not is_split(df):
        return df
    parts = [df.withColumn(HALO, F.lit(False))]
    hot = df.filter(F.col(CHUNK) > 0)
    for width, reverse in ((before, True), (after, False)):
        if width:
            parts.append(_halo_rows(hot, by, order, width, reverse))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _halo_rows(
    hot: DataFrame, by: Sequence[str], order: Sequence[str], width: int, reverse: bool
) -> DataFrame:
    """The ``width`` rows before each chunk (``reverse``) or after it."""
    chunk = Window.partitionBy(*by, CHUNK)
    inward, outward = ordering(order, reverse), ordering(order, not reverse)
    edge = hot.withColumn("_r", F.row_number().over(chunk.orderBy(*inward))).filter(
        F.col("_r") <= width
    )
    # Edge rows only: width rows per chunk, however large the group.
    across = Window.partitionBy(*by).orderBy(*outward).rowsBetween(-width, -1)
    nearest = edge.select(
        F.col(CHUNK).alias("_target"),
        F.row_number().over(chunk.orderBy(*outward)).alias("_r"),
        F.collect_list(F.struct(*hot.columns)).over(across).alias("_rows"),
    ).filter(F.col("_r") == 1)
    return nearest.select("_target", F.explode("_rows").alias("_row")).select(
        *[F.col(f"_row.{c}").alias(c) for c in hot.columns if c != CHUNK],
        F.col("_target").alias(CHUNK),
        F.lit(True).alias(HALO),
    )


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO) if HALO in df.columns else df


def with_group_values(
    df: DataFrame,
    by: Sequence[str],
    values: Mapping[str, Column],
    split: bool = False,
) -> DataFrame:
    """Attach plain aggregates over the whole group to each of its rows.

    With ``split``, groups may have any size: the aggregates are taken in one map-side combined pass,
    written, and joined back in a second one. Otherwise they are windows, which share the shuffle of
    the windows around them, and for rows cut into ranges a join with one row per group.
    """

    def totals():
        rows = without_halo(df)
        return rows.groupBy(*by).agg(*[agg.alias(name) for name, agg in values.items()])

    if is_split(df):
        return null_safe_join(df, totals(), by)
    if split:
        return null_safe_join(df, pin(totals(), "totals"), by)
    window = group_window(df, by)
    return df.withColumns({name: agg.over(window) for name, agg in values.items()})


def with_group_totals(
    df: DataFrame, by: Sequence[str], values: Mapping[str, str], split: bool = False
) -> DataFrame:
    """Attach the exact totals of columns over the whole group to each of its rows; see :mod:`functions.exact`."""
    if is_split(df) or split:
        totals = exact_totals(without_halo(df), by, values)
        return null_safe_join(df, pin(totals, "totals") if split else totals, by)
    sums = {}
    for name, column in values.items():
        sums |= summed_pieces(name, column)
    out = with_group_values(with_pieces(df, values), by, sums)
    return with_totals(without_pieces(out, values), list(values))


def with_last_known(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    column: str,
    out: str,
    reverse: bool = False,
) -> DataFrame:
    """Attach the latest known value of ``column`` up to and including each row.

    ``reverse`` gives the next known one instead, from the row itself on.
    """
    window = group_window(df, by).orderBy(*ordering(order, reverse))
    window = window.rowsBetween(Window.unboundedPreceding, 0)
    seen = df.withColumn(out, F.last(column, ignorenulls=True).over(window))
    if not is_split(df):
        return seen
    known = df.filter((F.col(CHUNK) > 0) & F.col(column).isNotNull())
    ends = df.filter(F.col(CHUNK) > 0).select(*by, CHUNK).distinct()
    outermost = F.min_by if reverse else F.max_by
    lasts = known.groupBy(*by, CHUNK).agg(outermost(column, F.struct(*order)).alias("_end"))
    ends = null_safe_join(ends, lasts, [*by, CHUNK])
    passed = Window.partitionBy(*by).orderBy(*ordering([CHUNK], reverse))
    passed = passed.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, CHUNK, F.last("_end", ignorenulls=True).over(passed).alias("_carry"))
    seen = null_safe_join(seen, carry, [*by, CHUNK])
    return seen.withColumn(out, F.coalesce(out, "_carry")).drop("_carry")


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    split: bool = True,
) -> DataFrame:
    """Attach running sums up to and including each row; ``by`` may be empty.

    Rows must be unique on ``by`` + ``order``. ``split=False`` says that no group is heavy.
    """
    return in_parts(df, by, order, lambda rows: _running_totals(rows, by, order, totals), split)


def ranged_totals(
    df: DataFrame, order: Sequence[str], totals: dict[str, Column], label: str = "ranges"
) -> DataFrame:
    """Running sums over all rows in one order, in two levels whatever their number.

    The rows are cut into ranges of ``order``, written with the number of their range, and summed within each; what
    precedes a range comes from one row per range. Rows must be unique on ``order``.
    """
    ranges = df.repartitionByRange(*ordering(order)).withColumn(CHUNK, F.spark_partition_id() + 1)
    return unsplit(_running_totals(pin(ranges, label), [], order, totals))


def _running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str], totals: dict[str, Column]
) -> DataFrame:
    window = group_window(df, by).orderBy(*ordering(order))
    window = window.rowsBetween(Window.unboundedPreceding, 0)
    running = df.withColumns({name: F.sum(term).over(window) for name, term in totals.items()})
    if not is_split(df):
        return running
    sums = (
        df.filter(F.col(CHUNK) > 0)
        .groupBy(*by, CHUNK)
        .agg(*[F.sum(term).alias(f"_sum_{name}") for name, term in totals.items()])
    )
    # One row per chunk.
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by,
        CHUNK,
        *[F.sum(f"_sum_{name}").over(earlier).alias(f"_before_{name}") for name in totals],
    )
    running = null_safe_join(running, offsets, [*by, CHUNK])
    for name in totals:
        zero = F.lit(0).cast(running.schema[name].dataType)
        before = F.coalesce(F.col(f"_before_{name}"), zero)
        # A chunk that starts with NULL terms has no running sum of its own yet.
        joined = F.when(
            F.col(name).isNull() & F.col(f"_before_{name}").isNull(), F.lit(None)
        ).otherwise(F.coalesce(F.col(name), zero) + before)
        running = running.withColumn(name, joined.cast(running.schema[name].dataType))
        running = running.drop(f"_before_{name}")
    return running
