"""Quality rules on whole texts, with lines that many documents of a host share left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared
from panelweave.llm.shared import let

# Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of five words that occur twice or more in ``words``.

    Windows are compared by a 64-bit hash of their words. Linear but for one sort of the windows
    of texts in which any window repeats.
    """

    def covered(starts: Column) -> Column:
        # Each window adds the words up to the start of the next one, five at most.
        gaps = F.transform(
            starts,
            lambda s, i: F.least(F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)),
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def same_as_neighbour(ordered: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)["hash"].eqNullSafe(x["hash"])
            return before | F.get(ordered, i + 1)["hash"].eqNullSafe(x["hash"])

        starts = F.transform(F.filter(ordered, twice), lambda x: x["start"])
        return let(F.array_sort(starts), covered)

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
        return F.transform(
            starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
        )

    def counted(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("start")))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            let(F.array_sort(placed), same_as_neighbour),
        ).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > WINDOW, let(windows(words), counted)).otherwise(
        F.lit(0).cast("long")
    )


def line_statistics(text: Column) -> Column:
    """Number of lines with a word that equal an earlier one."""
    worded = F.filter(shared.lines_of(text), lambda x: x.rlike(shared.NOT_SPACE))
    return let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def words_in_frequent(text: Column, frequent: Column) -> Column:
    """Number of words in the lines whose normal form has its hash in ``frequent``."""

    def words(line: Column) -> Column:
        hit = F.array_contains(frequent, F.xxhash64(shared.normal_line(line)))
        return F.when(hit, F.size(shared.words_of(line))).otherwise(0)

    counts = F.transform(shared.lines_of(text), words)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n)
    return F.when(F.size(frequent) > 0, total).otherwise(F.lit(0).cast("long"))


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    line_share: float = 0.1,
    line_docs: int = 10,
    min_left: float = 0.2,
) -> DataFrame:
    """Statistics and verdict for every row; the row itself is the struct column ``row``.

    Columns: row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words,
    base_failed, kept. Words are runs of anything but ASCII white space. ``base_failed``: fewer
    than ``min_words`` words, or over ``max_repeat_percent`` percent of them inside repeated windows
    of five words. Else a document is depleted, and not kept, if without the lines that are too
    frequent at its host (:func:`shared.frequent_lines`, near copies counted once) fewer than ``min_words`` words, or than
    ``min_left`` of its words, are left.

    NULL text reads as empty and fails; NULL hosts form one host. Equal rows get equal verdicts.
    An empty table gives an empty table. Extra columns stay inside ``row`` and cannot clash.
    The texts are read four times and never shuffled unless the table of frequent lines, or of the ids of
    likely copies, is too large to broadcast: these are written first, and Spark decides by their size.
    """
    often = shared.frequent_lines(docs, F.col(host), shared.text_of(text), line_share, line_docs, copies_once=True)
    rows = shared.with_row(
        docs, host=shared.null_safe_key(F.col(host)), text=shared.text_of(text)
    ).join(often.select("host", "lines"), "host", "left")
    content = F.col("text")

    def statistics(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(content, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            line_statistics(content).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            words_in_frequent(
                content, F.coalesce("lines", F.array().cast("array<bigint>"))
            ).alias("n_frequent_words"),
        )

    rows = rows.select(shared.ROW, let(shared.words_of(content), statistics).alias("s"))
    n = F.col("s.n_words")
    failed = (n < min_words) | (100 * F.col("s.n_repeat_words") > max_repeat_percent * n)
    left = n - F.col("s.n_frequent_words")
    depleted = (left < min_words) | (left < min_left * n)
    return rows.select(
        shared.ROW, "s.*", failed.alias("base_failed"), (~failed & ~depleted).alias("kept")
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that :func:`quality_rules` keeps, unchanged."""
    return shared.rows_back(quality_rules(docs, **options).filter("kept"))
