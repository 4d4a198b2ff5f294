"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Every stage takes NULLs in any column, empty and very long texts, repeated rows and further columns; an empty table
gives an empty one. All but the last return the columns that they were given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm.bag_minhash import one_of_each
from panelweave.llm.line_dedup import without_boilerplate
from panelweave.llm.mixing import mixed_rows
from panelweave.llm.quality_rules import keep_good
from panelweave.llm.queries import MIX, mix_levels, token_digests
from panelweave.llm.shared import table
from panelweave.sources.workspace import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. One without ten words, NULL and empty texts included, goes."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate among those of their source and language.

    NULL is a source and a language of its own; repeated rows count once and are all returned.
    """
    return without_boilerplate(docs, copies_once=True, within=["lang"])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id.

    Rows that repeat an id are reduced to one; rows without an id stay.
    """
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mixture, once for each epoch they are in. NULL languages and sources have shares too."""
    return mixed_rows(docs, mix_levels(), **MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to; NULL and empty texts have no ids."""
    return token_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_copies),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

# SQL cannot express byte-level BPE; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
