"""Expressions and small steps that several of these operators use."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.components import components
from panelweave.sources.workspace import pin

# White space between words, and its complement.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

ROW = "row"

# Near copies: shingles of so many words, shared in this part, found by so many keys.
SHINGLE = 5
COPY_PERCENT = 80
COPY_KEYS = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, as ``spark-submit --py-files`` would; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        # The driver serves the archive to executors for as long as the application runs.
        folder = tempfile.mkdtemp(prefix="panelweave-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        copy = f"{folder}/{os.path.basename(package)}"
        skip = shutil.ignore_patterns("__pycache__")
        shutil.copytree(package, f"{copy}/{os.path.basename(package)}", ignore=skip)
        spark.sparkContext.addPyFile(shutil.make_archive(copy, "zip", copy))
        _shipped.add(app)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row however often it is used."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    """The text column, NULL read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def normal_line(line: Column) -> Column:
    """A line in lower case with single blanks between its words; empty without words."""
    return F.lower(F.array_join(words_of(line), " "))


def null_safe_key(value: Column) -> Column:
    """Text that tells NULL from every value, so that NULL is a key of its own in joins."""
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("="), value.cast("string")))


def with_row(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct beside working columns, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[
        c.alias(name) for name, c in columns.items()
    ])


def rows_back(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def shingles_of(text: Column) -> Column:
    """Sorted hashes of the distinct windows of five words; a text of one to four words is one."""

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))
        every = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(words) > 0, F.array_sort(F.array_distinct(every)))

    hashes = let(words_of(text), lambda words: F.transform(words, lambda w: F.xxhash64(w)))
    return F.coalesce(let(hashes, windows), F.array().cast("array<bigint>"))


def near_copies(docs: DataFrame) -> DataFrame:
    """Classes of near copies among the documents of one host: doc, class; lone documents are left out.

    ``docs``: host, doc (one number for each host and text), text. Two texts are near copies if
    their sets of five-word windows have a Jaccard similarity of 0.8 or more; classes are what links
    reach. Neighbours among the 17 smallest window hashes are 16 keys; every text is compared, by whole sets,
    with the smallest of each of its keys at its host, so work grows with texts and not with pairs. Two texts of
    similarity 0.8 have no key in common with a probability of about 2e-5 (by arithmetic); those with a key in common are only
    missed where a smaller text that is like neither comes first in all of them.
    """

    def keys(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.least(F.size(hashes) - 2, F.lit(COPY_KEYS - 1)), F.lit(0)))
        every = F.transform(places, lambda i: F.xxhash64("host", F.get(hashes, i), F.get(hashes, i + 1)))
        return F.when(F.size(hashes) > 0, every)

    keyed = docs.select("doc", F.explode(let(shingles_of(F.col("text")), keys)).alias("key"))
    keyed = pin(keyed, "keys")
    heads = keyed.groupBy("key").agg(F.min("doc").alias("head"), F.max("doc").alias("last"))
    heads = pin(heads.filter("head != last").select("key", "head"), "heads")
    pairs = keyed.join(heads, "key").filter("doc != head")
    pairs = pin(pairs.select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    ids = pin(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "ids")
    sets = docs.join(ids, "doc", "left_semi").select("doc", shingles_of(F.col("text")).alias("set"))
    sets = pin(sets.groupBy("doc").agg(F.first("set").alias("set")), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("sum"))
    links = both.filter(100 * F.col("n") >= COPY_PERCENT * (F.col("sum") - F.col("n"))).select("a", "b")
    return components(pin(links, "links")).select(F.col("node").alias("doc"), F.col("root").alias("class"))


def frequent_lines(
    docs: DataFrame, host: Column, text: Column, share: float, at_least: int, copies_once: bool = False
) -> DataFrame:
    """Per host, the hashes of lines found in too many of its documents.

    A line is too frequent if over ``share`` of the host's documents, and at least ``at_least`` of
    them, contain it. Documents of one host with equal texts count once, in both numbers, so that
    exact copies make no line frequent; with ``copies_once``, so does each class of its near copies
    (:func:`near_copies`). Columns: host (null-safe key), n_docs, lines.

    A host has at most (its lines per document) / ``share`` such lines, so one array holds them.
    Both groupings have the line in their keys: a hot host or line is combined before each shuffle.
    """
    docs = docs.select(null_safe_key(host).alias("host"), text.alias("text"))
    docs = docs.select("host", F.xxhash64("host", "text").alias("doc"), "text")
    hashes = F.transform(lines_of(F.col("text")), normal_line)
    hashes = F.array_distinct(F.transform(F.filter(hashes, lambda x: x != ""), lambda x: F.xxhash64(x)))
    lines = docs.select("host", "doc", F.explode(hashes).alias("line")).distinct()
    totals = docs.select("host", "doc").distinct()
    if copies_once:
        classes = pin(near_copies(docs), "copies")
        one = F.coalesce("class", "doc").alias("doc")
        lines = lines.join(classes, "doc", "left").select("host", one, "line").distinct()
        totals = totals.join(classes, "doc", "left").select("host", one).distinct()
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = totals.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    often = counts.filter(F.col("n") >= at_least).join(totals, "host")
    often = often.filter(F.col("n") > share * F.col("n_docs"))
    often = often.groupBy("host").agg(F.first("n_docs").alias("n_docs"), F.collect_list("line").alias("lines"))
    return pin(often, "lines")
