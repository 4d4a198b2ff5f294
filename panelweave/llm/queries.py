"""The registered queries of these operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import byte_bpe, quality_gam, secret_scan, training_order
from panelweave.llm.bag_minhash import near_duplicates
from panelweave.llm.centroids import cluster_vectors
from panelweave.llm.embedding_tiles import near_vectors
from panelweave.llm.license_scan import scan_licences
from panelweave.llm.line_dedup import drop_boilerplate_lines
from panelweave.llm.mixing import mix_to_weights
from panelweave.llm.quality_rules import quality_rules
from panelweave.llm.shared import table, text_of, words_of
from panelweave.llm.url_templates import judge_urls
from panelweave.llm.word_runs import word_runs
from panelweave.sources.workspace import pin, shared_folder

RANKS = "byte_bpe_multi_50k.tiktoken"
END_OF_TEXT = 50256
ORDER_KEY = 20_240_501
KEPT_SCORE = 0.3
CLUSTERS = {"k": 40, "rounds": 5, "seed": 2}

# The mixture: two domains, languages within them, sources of equal weight. Shares are relative to siblings.
MIX_WEIGHTS = {
    ("web",): 3,
    ("books",): 2,
    ("web", "en"): 6,
    ("web", "de"): 2,
    ("books", "en"): 4,
    ("books", "fr"): 2,
}
MIX = {"weights": MIX_WEIGHTS, "budget_share": 0.7, "max_epochs": 2, "seed": 17}


def mix_levels() -> dict[str, Column]:
    """Domain, language and source; a source's domain is told by the first digit of its md5."""
    first = F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 1)
    domain = F.when(first < "8", "web").otherwise("books")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, counted by kind and as digests."""
    found = secret_scan.find_secrets(table(spark, folder, "documents"))

    def number(kind: str) -> Column:
        of_kind = F.filter("spans", lambda x: x["kind"] == F.lit(kind))
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != F.lit("novel"))
    return found.select(
        "doc_id",
        *[number(k) for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
        number("novel"),
    )


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the boilerplate lines of their source: lines, dropped lines, digest."""
    cleaned = drop_boilerplate_lines(table(spark, folder, "documents"))
    return cleaned.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return judge_urls(table(spark, folder, "pages"))


def training_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every token sequence of the documents with its place in training order, read back from the shards."""
    path = public_tokenizers.path(RANKS)
    docs = table(spark, folder, "documents")
    sequences = training_order.packed_sequences(docs, path, public_tokenizers.PATTERN, END_OF_TEXT)
    out = f"{shared_folder(spark)}/training-{uuid.uuid4().hex}"
    return training_order.write_training_shards(pin(sequences, "sequences"), out, ORDER_KEY, END_OF_TEXT)


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by a model fitted on the labels outside fold 0."""
    docs = table(spark, folder, "documents")
    model = quality_gam.train(docs, table(spark, folder, "labels"))
    scored = quality_gam.score(docs, model)
    return scored.select(
        "doc_id",
        (quality_gam.fold_of(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= KEPT_SCORE).cast("int").alias("predicted"),
    )


def token_digests(docs: DataFrame) -> DataFrame:
    """Every document encoded and decoded again: number of ids, digests of ids and of bytes."""
    path = public_tokenizers.path(RANKS)
    tokens = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def byte_bpe_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    return token_digests(table(spark, folder, "documents"))


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents chosen to the target weights, once for each epoch they are in."""
    mixed = mix_to_weights(table(spark, folder, "documents"), mix_levels(), **MIX)
    return mixed.select("row.doc_id", "domain", "lang", "source", "tokens", "epoch")


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of the quality rules for every document."""
    judged = quality_rules(table(spark, folder, "documents"))
    return judged.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_frequent_words",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(table(spark, folder, "embeddings"))


def minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates(table(spark, folder, "documents"))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector, with the inertia and the digest of its centroid."""
    clustered = cluster_vectors(table(spark, folder, "embeddings"), **CLUSTERS)
    listed = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return clustered.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(listed, 256).alias("centroid_sha256")
    )


def licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence marks of every document: places of phrases, labels of phrases and of templates found."""
    found = scan_licences(table(spark, folder, "documents"))
    base = F.col("places.label")
    every = F.concat(base, F.col("blocks.label"))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.part"), F.lit(0.0)))
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["start"].cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1)["start"].cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        score.alias("score"),
    )


def repeating_words(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of them made periodic: word i from a on becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", text_of().alias("text"), h.alias("h"), g.alias("g"))
    chosen = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    n = F.size("words")
    chosen = chosen.withColumn("a", F.when(n > 0, F.col("g") % n))
    chosen = chosen.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i).cast("int")))
    text = F.when(n > 0, F.array_join(made, " ")).otherwise(F.col("text"))
    return chosen.select("doc_id", text.alias("text"))


def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words of every document: the strongest run, digests of all runs and of what is kept."""
    found = word_runs(repeating_words(table(spark, folder, "documents")))

    def stronger(x: Column, y: Column) -> Column:
        more = y["length"] * x["period"] - x["length"] * y["period"]
        first = F.when(more != 0, more).when(x["start"] != y["start"], x["start"] - y["start"])
        return F.signum(first.otherwise(x["period"] - y["period"])).cast("int")

    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get(F.array_sort("runs", stronger), F.lit(0))
    return found.select("*", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets,
    "op2_line_dedup": line_dedup,
    "op3_url_templates": url_filter,
    "op4_training_order": training_shards,
    "op5_quality_gam": quality_scores,
    "op6_byte_bpe": byte_bpe_tokens,
    "op7_mixing_weights": mixture,
    "op8_quality_rules": rules,
    "op9_embedding_tiles": vectors,
    "op10_bag_minhash": minhash,
    "op11_centroid_search": clusters,
    "op12_license_scan": licences,
    "op13_word_runs": periodic_runs,
}
