"""Sums and means of numbers that are the same whatever the order of addition.

A double stands for the decimal it prints as. Numbers of up to four places, as most measures are, add up as whole
ten-thousandths, in two halves so that no long overflows; others as decimals of eighteen places.
Only the finished sum is rounded. Other numbers from 1e12 on in size and those not finite make the
sum one of doubles, as do numbers so small that eighteen places would not tell them apart.

A total is a struct of the sums, which later expressions read: ``low``, ``high`` and ``other`` make the exact
sum, ``shorts`` and ``others`` count what is in it, ``near`` is the sum of doubles, ``n`` the number of known values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = 18
SUM_TYPE = f"decimal(38,{PLACES})"

SHORT_PLACES = 4
SHORT_UNITS = 10**SHORT_PLACES
HALF = 26
LARGEST = 1e12
# A mean below this size is taken from the sum of doubles, as it needs digits beyond the eighteenth place.
SMALL = 2.0**-20
# Means from this size on are given by their eighteen places, which identify the nearest double.
PRINTED = 2.0**-6


def _part(name: str, part: str) -> str:
    """The column that holds a part of the total called ``name``."""
    return f"{name}__{part}"


def _names(name: str, column: str) -> dict[str, str]:
    """SQL names of a value and its parts."""
    parts = ("units", "decimal")
    return {"value": f"`{column}`", **{part: f"`{_part(name, part)}`" for part in parts}}


def exact_totals(
    df: DataFrame,
    by: Sequence[str],
    values: Mapping[str, str],
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Totals per ``by``, or of all rows, of columns by the name of the total, with the plain aggregates ``also``."""
    aggregates = dict(also or {})
    for name, column in values.items():
        aggregates |= summed_pieces(name, column)
    sums = with_pieces(df, values).groupBy(*by)
    return with_totals(sums.agg(*[c.alias(out) for out, c in aggregates.items()]), list(values))


def with_pieces(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Add to each value what it is added as: ten-thousandths or a decimal."""
    types = {name: df.schema[column].dataType for name, column in values.items()}
    whole = {n for n, t in types.items() if isinstance(t, (T.IntegralType, T.DecimalType))}
    # Steps of their own, since expressions that repeat one another grow fast.
    steps = (
        {"units": (UNITS, "CAST(NULL AS BIGINT)")},
        {"units": (SHORT, None)},
        {"decimal": (OTHER, f"TRY_CAST({{value}} AS {SUM_TYPE})")},
    )
    for step in steps:
        columns = {}
        for name, column in values.items():
            for out, sql in step.items():
                if sql[name in whole]:
                    columns[_part(name, out)] = F.expr(sql[name in whole].format_map(_names(name, column)))
        df = df.withColumns(columns)
    return df


def without_pieces(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[_part(n, part) for n in names for part in ("units", "decimal")])


UNITS = f"rint(CAST({{value}} AS DOUBLE) * {SHORT_UNITS})"
SHORT = f"CAST(IF(abs({{units}}) < {2**53}D AND {{units}} / {SHORT_UNITS}D = {{value}}, {{units}}, NULL) AS BIGINT)"
OTHER = f"CAST(IF({{units}} IS NULL AND abs({{value}}) < {LARGEST!r}D, CAST({{value}} AS DOUBLE), NULL) AS {SUM_TYPE})"
SUMS = {
    "low": f"sum({{units}} & {(1 << HALF) - 1}L)",
    "high": f"sum(shiftright({{units}}, {HALF}))",
    "other": "try_sum({decimal})",
    "shorts": "count({units})",
    "others": "count({decimal})",
    "near": "sum(CAST({value} AS DOUBLE))",
    "n": "count({value})",
}


def summed_pieces(name: str, column: str) -> dict[str, Column]:
    """Plain aggregates for a value, by the columns that :func:`with_totals` reads."""
    return {_part(name, out): F.expr(sql.format_map(_names(name, column))) for out, sql in SUMS.items()}


def with_totals(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Turn the sums into totals."""
    totals = {n: F.struct(*[F.col(_part(n, part)).alias(part) for part in SUMS]) for n in names}
    return df.withColumns(totals).drop(*[_part(n, part) for n in names for part in SUMS])


def merged_totals(totals: Column) -> Column:
    """Aggregate: the total of totals."""
    fields = {out: (F.try_sum if out == "other" else F.sum)(totals[out]) for out in SUMS}
    # A sum of decimals that did not fit in a part leaves none.
    lost = F.count(F.when((totals["others"] > 0) & totals["other"].isNull(), 1)) > 0
    fields["other"] = F.when(~lost, fields["other"])
    return F.struct(*[value.alias(out) for out, value in fields.items()])


_EXACT = f"""(TRY_CAST((CAST({{x}}.high AS DECIMAL(20,0)) * {1 << HALF}BD + CAST({{x}}.low AS DECIMAL(20,0)))
  * {Decimal(1).scaleb(-SHORT_PLACES)}BD AS DECIMAL(37,{PLACES})))"""
_OTHER = f"TRY_CAST({{x}}.other AS DECIMAL(37,{PLACES}))"


def _exact(total: str) -> str:
    """The sum as a decimal of eighteen places, or NULL."""
    x = f"`{total}`"
    short, other = _EXACT.format(x=x), _OTHER.format(x=x)
    mixed = f"CAST(coalesce({short}, 0BD) + {other} AS {SUM_TYPE})"
    return f"""CASE WHEN {x}.shorts = {x}.n AND {x}.n > 0 THEN CAST({short} AS {SUM_TYPE})
      WHEN {x}.shorts + {x}.others = {x}.n AND abs({x}.near) >= {SMALL!r}D * {x}.n THEN {mixed} END"""


def total_as_double(total: str) -> Column:
    """The total in the column of this name, rounded once."""
    return F.expr(f"coalesce(CAST({_exact(total)} AS DOUBLE), `{total}`.near)")


def _quotient(total: str) -> str:
    """The mean to eighteen places, or NULL."""
    return f"CAST(try_divide({_exact(total)}, CAST(`{total}`.n AS DECIMAL(19,0))) AS {SUM_TYPE})"


def exact_mean(total: str, dtype: T.DataType = T.DoubleType()) -> Column:
    """The mean of the total in the column of this name: of decimals a decimal of four more places, else the nearest double."""
    quotient = _quotient(total)
    if isinstance(dtype, T.DecimalType):
        places = min(dtype.scale + 4, PLACES)
        return F.expr(f"TRY_CAST(round({quotient}, {places}) AS DECIMAL({min(dtype.precision + 4, 38)},{places}))")
    near = f"try_divide(coalesce(CAST({_exact(total)} AS DOUBLE), `{total}`.near), `{total}`.n)"
    plain = f"abs(`{total}`.near) >= {PRINTED!r}D * `{total}`.n"
    return F.expr(f"IF({plain}, coalesce(CAST({quotient} AS DOUBLE), {near}), {near})")


def rounded_mean(total: str, digits: int) -> Column:
    """The mean as a double, rounded once, half away from zero."""
    near = f"round(try_divide(`{total}`.near, `{total}`.n), {digits})"
    return F.expr(f"coalesce(CAST(round({_quotient(total)}, {digits}) AS DOUBLE), {near})")


def below_mean_part(value: Column, total: str, divisor: float) -> Column:
    """``value`` < mean / ``divisor``, strictly and without rounding of the mean.

    Doubles decide where they are far from equal, by a millionth; decimals, which take longer, where they are not.
    """
    up, down = Decimal(str(divisor)).as_integer_ratio()
    bound = f"try_divide({_exact(total)}, CAST(`{total}`.n * {up}BD AS DECIMAL(19,0)))"
    bound = F.expr(bound if down == 1 else f"{bound} * {down}BD")
    number, near = value.cast("double"), F.expr(f"try_divide(`{total}`.near, `{total}`.n)") / divisor
    apart = F.abs(number - near) > 1e-6 * (F.abs(number) + F.abs(near))
    exact = F.coalesce(value.try_cast(SUM_TYPE) < bound, number < near)
    return F.when(apart, number < near).otherwise(exact)


def exact_midpoint(a: Column, b: Column, dtype: T.DataType, digits: int | None = None) -> Column:
    """The mean of two values of type ``dtype``, rounded once if at all; NULL if either is."""

    def rounded(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    if isinstance(dtype, T.DecimalType):
        return rounded((a + b) / 2)
    near = (a.cast("double") + b.cast("double")) / 2
    middle = (a.try_cast("decimal(37,18)") + b.try_cast("decimal(37,18)")) / F.lit(Decimal(2))
    middle = F.when(F.abs(near) >= PRINTED, middle)
    return F.coalesce(rounded(middle).cast("double"), rounded(near))
