"""Reading raw panels and writing cleaned ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.sources.workspace import pin


def read_raw(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    fmt: str = "csv",
) -> DataFrame:
    """Read a staging table with every column as nullable text; nothing is inferred.

    ``columns`` is the file's own column order for ``csv``, and the projection for ``parquet`` and
    ``orc``, whose stored types are turned into text. A csv line with more or fewer fields than there are
    columns is an error when it is read, whichever columns are used.
    """
    if fmt == "csv":
        if not columns:
            raise ValueError("csv input needs its column names")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = spark.read.option("columnPruning", False)
        return reader.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")
    df = spark.read.format(fmt).load(path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns or df.columns])


def read_with_quarantine(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str],
    quarantine: str,
    most_bad: int,
    header: bool = True,
) -> DataFrame:
    """Read csv as :func:`read_raw` does, but set lines with more or fewer fields than ``columns`` aside.

    Such lines are written to the parquet folder ``quarantine``, which must not exist yet, as ``file`` and ``line``
    (its whole text); all others are returned. More than ``most_bad`` of them are a ``ValueError``, raised when they
    are stored, so that they can be looked at. A field that holds a line end makes two lines. Empty lines are skipped.
    With ``header``, files begin with the names of the columns, and a file with other names is an error.

    The files are parsed once, into a table of the shared folder that tells good from bad lines by partition.
    """
    bad, file, is_bad = _free_names(columns, ("bad_line", "file", "is_bad"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, bad]])
    reader = spark.read.option("columnPruning", False).option("columnNameOfCorruptRecord", bad)
    parsed = reader.csv(path, schema=schema, header=header, enforceSchema=not header, mode="PERMISSIVE")
    marked = parsed.select("*", F.col("_metadata.file_path").alias(file), F.col(f"`{bad}`").isNotNull().alias(is_bad))
    lines = pin(marked, "lines", partition_by=[is_bad])
    aside = lines.filter(F.col(f"`{is_bad}`"))
    aside.select(F.col(f"`{file}`").alias("file"), F.col(f"`{bad}`").alias("line")).write.parquet(quarantine)
    count = aside.count()
    if count > most_bad:
        raise ValueError(f"{count} bad lines, {most_bad} are allowed: see {quarantine}")
    return lines.filter(~F.col(f"`{is_bad}`")).select(*[F.col(f"`{c}`") for c in columns])


def _free_names(columns: Sequence[str], names: Sequence[str]) -> list[str]:
    """``names`` with as many underscores before them as it takes to differ from ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    prefix = "_"
    while any(prefix + name in taken for name in names):
        prefix += "_"
    return [prefix + name for name in names]


def write_panel(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Store a cleaned panel. Partition only by columns with few values, such as the period."""
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)
