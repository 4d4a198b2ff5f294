"""Token sequences in training order, in shards of fixed stride."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm import shared
from panelweave.llm.byte_bpe import read_ranks
from panelweave.sources.workspace import pin

LENGTH = 2048
PER_SHARD = 256
ROUNDS = 4
BATCH_CHARS = 4_000_000
TOKEN = np.dtype("<u2")  # ids below 65,536


def _mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, count: int, key: int) -> np.ndarray:
    """Slots of ``index`` under a keyed permutation of 0 .. count - 1.

    A Feistel network permutes the numbers of the smallest even number of bits that holds the
    count, at most four times as many; a result outside is put in again until one is inside, which
    keeps it a permutation and takes four turns at most on average.
    """
    half = max(1, -(-max(count - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    turns = _mix(np.uint64([key & (2**64 - 1)]) + np.arange(ROUNDS, dtype=np.uint64))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for turn in turns:
            left, right = right, left ^ (_mix(right ^ turn) & mask)
        return (left << np.uint64(half)) | right

    out = network(np.asarray(index).astype(np.uint64))
    while (outside := out >= np.uint64(count)).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


@lru_cache(2)
def _tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def packed_sequences(
    docs: DataFrame, path: str, pattern: str, end: int, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token ids of the texts, each with ``end`` after it, cut into sequences of ``length``.

    Columns: part (of the input), number (within the part, from 0), doc_ids (documents with tokens
    in the sequence, in order), n_tokens, tokens (binary, compressed; ``n_tokens`` ids of two bytes).
    Sequences are filled across texts; only the last of a part may be shorter. A worker holds one sequence and a few million
    characters of text at a time.

    A NULL or empty text is the token ``end`` alone, so its document has a place too; a text longer than a sequence goes on in
    the next ones. NULL and repeated ids are listed as they come, repeated rows are packed as often. An empty table
    gives no sequences. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        squeeze = zstandard.ZstdCompressor(level=1)
        part, number = 0, 0
        waiting = np.zeros(0, TOKEN)
        owners: list[tuple[int | None, int]] = []  # documents in waiting, with their tokens there

        def row(ids: np.ndarray) -> dict:
            nonlocal number, owners
            left, taken = len(ids), []
            while left:
                doc, n = owners[0]
                taken.append(doc)
                used = min(n, left)
                left -= used
                owners[:1] = [(doc, n - used)] if n > used else []
            made = {
                "part": part, "number": number, "doc_ids": taken, "n_tokens": len(ids),
                "tokens": squeeze.compress(ids.tobytes()),
            }
            number += 1
            return made

        def full() -> Iterator[dict]:
            nonlocal waiting
            at = 0
            while len(waiting) - at >= length:
                yield row(waiting[at : at + length])
                at += length
            waiting = waiting[at:]

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            texts, made, chars = [], [], 0
            for k in range(batch.num_rows):
                texts.append(batch.column(1)[k].as_py())
                chars += len(texts[-1])
                if chars < BATCH_CHARS and k < batch.num_rows - 1:
                    continue
                ids = [np.array([*i, end], TOKEN) for i in map(tokenizer.encode_ordinary, texts)]
                first = k + 1 - len(texts)
                owners += [(batch.column(0)[first + i].as_py(), len(x)) for i, x in enumerate(ids)]
                waiting = np.concatenate([waiting, *ids])
                texts, chars = [], 0
                made += full()
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
        if len(waiting):
            yield pa.RecordBatch.from_pylist([row(waiting)], schema)

    schema = pa.schema(
        [("part", pa.int32()), ("number", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int32()), ("tokens", pa.binary())]
    )
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), shared.text_of(text).alias("text"), F.spark_partition_id().alias("part")
    )
    return shared.map_arrow(rows, run, "part int, number long, doc_ids array<long>, n_tokens int, tokens binary")


def write_training_shards(
    sequences: DataFrame, folder: str, key: int, pad: int, length: int = LENGTH, per_shard: int = PER_SHARD
) -> DataFrame:
    """Write the sequences in the order of a keyed permutation; returns the index of what was written.

    ``folder/shards`` gets one row per shard: shard, first_slot, n_sequences, payload. Slot s is in
    shard s // per_shard, at byte (s % per_shard) * 2 * length of its payload, ``pad`` filling up a
    short sequence, so any slot is found by arithmetic (:func:`read_slots`). The index is what
    :func:`read_index` reads back from the shards.

    ``sequences`` must be a written table: its rows number the slots, so a second reading must see
    the same ones. Parts are numbered by running counts, one row per part. Sequences move once, to contiguous
    ranges of slots; a task holds one shard. No sequences give no shards and an empty index; equal sequences have
    slots of their own.
    """
    counts = sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pin(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "offsets")
    total = sequences.count()
    numbered = sequences.join(offsets, "part").withColumn("place", F.col("start") + F.col("number"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permuted(batch.column(0).to_numpy(), total, key)
            columns = [pa.array(slot), pa.array(slot // per_shard), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "doc_ids", "n_tokens", "tokens"])

    schema = "slot long, shard long, doc_ids array<long>, n_tokens int, tokens binary"
    placed = shared.map_arrow(numbered.select("place", "doc_ids", "n_tokens", "tokens"), slots, schema)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        current, payload, index = None, [], []

        def done() -> pa.RecordBatch:
            columns = {"shard": [current], "first_slot": [current * per_shard], "n_sequences": [len(payload)]}
            columns |= {"payload": [b"".join(payload)], "sequences": [index]}
            return pa.RecordBatch.from_pydict(columns, out)

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != current:
                    if payload:
                        yield done()
                    current, payload, index = r["shard"], [], []
                ids = np.full(length, pad, TOKEN)
                ids[: r["n_tokens"]] = np.frombuffer(unpack.decompress(r["tokens"]), TOKEN)
                payload.append(ids.tobytes())
                index.append({"slot": r["slot"], "doc_ids": r["doc_ids"], "n_tokens": r["n_tokens"]})
        if payload:
            yield done()

    entry = pa.struct([("slot", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int32())])
    out = pa.schema(
        [("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int32()), ("payload", pa.binary()), ("sequences", pa.list_(entry))]
    )
    n_shards = -(-total // per_shard)
    partitions = max(1, min(n_shards, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # Contiguous ranges of shards, as even as can be.
    ranged = placed.repartitionById(partitions, F.floor(F.col("shard") * partitions / F.lit(max(n_shards, 1))).cast("int"))
    written = shared.map_arrow(ranged.sortWithinPartitions("slot"), 
        shards,
        "shard long, first_slot long, n_sequences int, payload binary, "
        "sequences array<struct<slot:bigint,doc_ids:array<bigint>,n_tokens:int>>",
    )
    written.write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}/shards")
    spark = sequences.sparkSession
    return read_index(spark, folder, length, per_shard)


def read_index(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """What was written of every sequence: slot, shard, offset (bytes in the payload), doc_ids,
    n_tokens, tokens_sha256 (of its bytes in the shard, filling included)."""
    stride = length * TOKEN.itemsize
    offset = F.pmod(F.col("s.slot"), F.lit(per_shard)) * stride
    shards = spark.read.parquet(f"{folder}/shards")
    digests = F.transform("sequences", lambda s, i: F.sha2(F.substring("payload", i * stride + 1, F.lit(stride)), 256))
    # Zipped before rows are made, so that none of them carries a payload.
    both = F.explode(F.arrays_zip(F.col("sequences").alias("s"), digests.alias("d")))
    rows = shards.select("shard", both.alias("z")).select("shard", F.col("z")["s"].alias("s"), F.col("z")["d"].alias("tokens_sha256"))
    return rows.select("s.slot", "shard", offset.alias("offset"), "s.doc_ids", "s.n_tokens", "tokens_sha256")


def read_slots(spark: SparkSession, folder: str, start: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Sequences from slot ``start`` on, to resume training there: slot, tokens (binary, fixed stride).

    The filter on the shard number reaches the files, so earlier shards are not read.
    """
    stride = length * TOKEN.itemsize
    shards = spark.read.parquet(f"{folder}/shards").filter(F.col("shard") >= start // per_shard)
    places = F.sequence(F.lit(0), F.col("n_sequences") - 1)
    cut = F.transform(places, lambda i: F.substring("payload", i * stride + 1, F.lit(stride)))
    rows = shards.select("first_slot", F.posexplode(cut).alias("place", "tokens"))
    slot = F.col("first_slot") + F.col("place")
    return rows.filter(slot >= start).select(slot.alias("slot"), "tokens")
