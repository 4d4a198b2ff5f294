"""Removal of boilerplate lines by their frequency at the host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared
from panelweave.llm.shared import let


def drop_boilerplate_lines(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = 0.1,
    min_pages: int = 5,
    copies_once: bool = False,
    within: Sequence[str] = (),
) -> DataFrame:
    """Every row with its boilerplate lines removed; the row itself is the struct column ``row``.

    Columns: row, text (without those lines), n_lines, n_dropped (long). A line is boilerplate if
    over ``ratio`` of its host's pages, and at least ``min_pages`` of them, contain its normal form
    (lower case, single blanks); pages of a host with equal texts count as one page, and with
    ``copies_once`` so does each class of near copies (:func:`shared.near_copies`). Lines without
    words always stay, so the rest of the layout does not change. A page of nothing but boilerplate
    becomes empty and stays.

    With columns in ``within``, such as the language, each of their values at a host is a host of its
    own, so that a line of a small part of a host is measured against that part.

    NULL text reads as empty; NULL hosts form one host; equal rows stay equal; an empty table gives
    an empty table; extra columns stay inside ``row``. Texts are not shuffled unless the written
    table of boilerplate lines is too large to broadcast.
    """
    group = F.col(host)
    if within:
        group = F.to_json(F.array(*[shared.null_safe_key(F.col(c)) for c in (host, *within)]))
    often = shared.frequent_lines(docs, group, shared.text_of(text), ratio, min_pages, copies_once)
    rows = shared.with_row(
        docs, host=shared.null_safe_key(group), text=shared.text_of(text)
    ).join(often.select("host", "lines"), "host", "left")

    def cleaned(lines: Column) -> Column:
        def stays(line: Column) -> Column:
            return ~F.array_contains("lines", F.xxhash64(shared.normal_line(line)))

        kept = F.when(F.col("lines").isNull(), lines).otherwise(F.filter(lines, stays))
        return let(
            kept,
            lambda left: F.struct(
                F.array_join(left, "\n").alias("text"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(left)).cast("long").alias("n_dropped"),
            ),
        )

    done = rows.select(shared.ROW, let(shared.lines_of(F.col("text")), cleaned).alias("c"))
    return done.select(shared.ROW, "c.*")


def without_boilerplate(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The table itself with boilerplate lines removed from ``text``; ``n_chars``, if there, follows."""
    cleaned = drop_boilerplate_lines(docs, text=text, **options)
    new = {text: F.col("text"), "n_chars": F.length("text").cast("long")}
    return cleaned.select(
        *[new.get(c, F.col(f"{shared.ROW}.`{c}`")).alias(c) for c in docs.columns]
    )
