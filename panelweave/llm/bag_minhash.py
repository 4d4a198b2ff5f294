"""Near-duplicate documents by weighted Jaccard similarity of their word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared
from panelweave.llm.components import components
from panelweave.sources.workspace import pin

WORDS = 5
SIMILARITY = 0.8
ROWS_PER_BAND = 6
BANDS = 32
SLOTS = ROWS_PER_BAND * BANDS
# Pairs whose signatures agree in fewer slots are not compared in full. A pair of similarity 0.8 is
# lost by this with a probability of 2e-5, less than by the bands (6e-5).
LEAST_AGREEMENT = 131
# Buckets in which more pairs could meet are compared tile by tile, of so many texts or shingles.
SMALL_BUCKET = 1_000
TILE = 1_024
TILE_SHINGLES = 2_000_000
COLUMNS = 2_048
# Shingles that one numpy step works on at once, so that memory does not depend on the batch.
STEP = 400_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random (the finaliser of splitmix64)."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _wait(seed: np.ndarray, rate: np.ndarray | float) -> np.ndarray:
    """Exponential waiting times drawn from ``seed``."""
    uniform = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(uniform) / rate


def shingles(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of five words, and the text each belongs to.

    ``words`` are the texts' word hashes one after another; text i has ``starts[i]:starts[i+1]``.
    A text of one to four words is one shingle; a text without words has none.
    """
    sizes = np.diff(starts)
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, (sizes > 0).astype(sizes.dtype))
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(starts[:-1], counts) + np.arange(len(owner)) - first
    left = np.repeat(starts[1:], counts) - at
    hashes = _mix(np.minimum(left, WORDS).astype(np.uint64))
    for k in range(WORDS):
        inside = left > k
        word = np.zeros(len(at), np.uint64)
        word[inside] = words[at[inside] + k]
        hashes = np.where(inside, _mix(hashes ^ word), hashes)
    return hashes, owner


def _order(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order by owner, then hash; numpy sorts small owners by their digits."""
    order = np.argsort(hashes)
    small = len(owner) == 0 or owner.max() < 2**16
    return order[np.argsort(owner[order].astype(np.uint16 if small else np.int64), kind="stable")]


def bags(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with the number of times it occurs: owner, hash, weight."""
    order = _order(owner, hashes)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weights = np.diff(np.append(at, len(hashes)))
    return owner[at], hashes[at], weights


def signatures(
    owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, slots: int = SLOTS
) -> np.ndarray:
    """BagMinHash signatures, one row of ``slots`` times per text; zeros for an empty bag.

    Every shingle has a Poisson process of unit rate over weight, whose points carry a time and a
    slot; a slot's value is the time of its first point below the text's weights. Two texts agree
    in a slot with a probability equal to the weighted Jaccard similarity of their bags.

    Weights are whole numbers. A shingle's weight axis is cut into [0,1), [1,2), [2,4), [4,8) and so
    on; each piece only draws its first point, and is halved to find where that point lies and when
    the other half has its first. Pieces beyond the weight, and points later than the time by which
    the text's slots are full, are dropped, so a text costs about its shingles plus slots * log(slots).
    Where a slot is still empty then, the text is done again with a later time.
    """
    out = np.full((texts, slots), np.inf)
    total = np.bincount(owner, weights, texts)
    slack, todo = 4.0, total > 0
    while todo.any():
        limit = np.where(todo, slots * (math.log(slots) + slack) / np.maximum(total, 1), 0.0)
        chosen = todo[owner]
        _fill(out, owner[chosen], hashes[chosen], weights[chosen], limit)
        todo = todo & np.isinf(out).any(axis=1)
        slack *= 2
    out[total == 0] = 0.0
    return out


def _fill(out, owner, hashes, weights, limit) -> None:
    """Lower each slot of ``out`` to its first point up to ``limit`` of its text."""
    slots = out.shape[1]
    low, size = np.zeros(len(owner), np.int64), np.ones(len(owner), np.int64)
    text, key, weight = owner, hashes, weights
    nodes = []
    while len(text):
        time = _wait(_mix(key ^ _mix(low.astype(np.uint64))), size)
        keep = time <= limit[text]
        nodes.append([x[keep] for x in (text, key, weight, low, size, time)])
        low, size = low + size, np.where(low > 0, size * 2, size)
        more = weight > low
        text, key, weight, low, size = (x[more] for x in (text, key, weight, low, size))
    if not nodes:
        return
    text, key, weight, low, size, time = (np.concatenate(x) for x in zip(*nodes, strict=True))
    units = [[x[size == 1] for x in (text, key, low, time)]]
    inner = size > 1
    text, key, weight, low, size, time = (x[inner] for x in (text, key, weight, low, size, time))
    while len(text):
        half = size // 2
        seed = _mix(key ^ _mix(low.astype(np.uint64) * np.uint64(64) + np.log2(size).astype(np.uint64)))
        right_first = (seed & np.uint64(1)).astype(bool)
        later = time + _wait(_mix(seed), half)
        left_time = np.where(right_first, later, time)
        right_time = np.where(right_first, time, later)
        text, key, weight = (np.concatenate([x, x]) for x in (text, key, weight))
        low, size = np.concatenate([low, low + half]), np.concatenate([half, half])
        time = np.concatenate([left_time, right_time])
        keep = (low < weight) & (time <= limit[text])
        done, go = keep & (size == 1), keep & (size > 1)
        units.append([x[done] for x in (text, key, low, time)])
        text, key, weight, low, size, time = (x[go] for x in (text, key, weight, low, size, time))
    text, key, low, time = (np.concatenate(x) for x in zip(*units, strict=True))
    seed = _mix(key ^ _mix(low.astype(np.uint64) ^ _GOLDEN))
    flat, bound = out.reshape(-1), limit[text]
    while len(text):
        slot = (seed >> np.uint64(40)).astype(np.int64) % slots
        np.minimum.at(flat, text * slots + slot, time)
        seed = _mix(seed)
        time = time + _wait(seed, 1.0)
        seed = _mix(seed)
        keep = time <= bound
        if not keep.all():
            text, seed, time, bound = (x[keep] for x in (text, seed, time, bound))


def overlaps(words_a: np.ndarray, starts_a: np.ndarray, words_b: np.ndarray, starts_b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the shingle bags of texts a[i] and b[i]; 0 without words."""
    n = len(starts_a) - 1
    starts = np.concatenate([starts_a, starts_b[1:] + len(words_a)])
    owner, hashes, weights = bags(*shingles(np.concatenate([words_a, words_b]), starts))
    pair = owner % max(n, 1)
    order = _order(pair, hashes)
    pair, hashes, weights = pair[order], hashes[order], weights[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1]))
    both = np.bincount(pair[same], np.minimum(weights[same], weights[same + 1]), n)
    return both / np.maximum(np.bincount(pair, weights, n) - both, 1)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (as unsigned) and starts of a list column of longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return values, starts


def _signed_parts(batch: pa.RecordBatch, slots: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids (column 0) and signatures, as mixed bits, of parts of a batch of word hashes (column 1)."""
    words, starts = _flat(batch.column(1))
    a = 0
    while a < batch.num_rows:
        # Texts up to STEP words, one at least.
        end = int(np.searchsorted(starts, starts[a] + STEP, side="right")) - 1
        b = min(max(a + 1, end), batch.num_rows)
        part = starts[a : b + 1]
        bag = bags(*shingles(words[part[0] : part[-1]], part - part[0]))
        yield batch.column(0).slice(a, b - a), _mix(signatures(*bag, b - a, slots).view(np.uint64))
        a = b


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands as one number each, and a byte of every slot, with which slots are compared later."""
    for batch in batches:
        for ids, mixed in _signed_parts(batch, SLOTS):
            band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(mixed), BANDS))
            for k in range(ROWS_PER_BAND):
                band = _mix(band ^ mixed[:, k::ROWS_PER_BAND])
            ends = np.arange(len(mixed) + 1, dtype=np.int32) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, bands, _bytes(mixed)], ["node", "bands", "codes"])


def _bytes(mixed: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in (mixed >> np.uint64(56)).astype(np.uint8)], pa.binary())


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bags as sets: each shingle once for every time it occurs, numbered."""
    for batch in batches:
        words, starts = _flat(batch.column(1))
        owner, hashes, weights = bags(*shingles(words, starts))
        turn = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
        items = _mix(np.repeat(hashes, weights) ^ _mix(turn.astype(np.uint64))).view(np.int64)
        ends = np.append(0, np.cumsum(np.bincount(owner, weights, batch.num_rows))).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(ends), pa.array(items))
        yield pa.RecordBatch.from_arrays([batch.column(0), column], ["node", "items"])


def _codes(column: pa.Array | pa.ChunkedArray, slots: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, slots)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, x, y), the pairs whose signatures x and y agree in enough slots."""
    for batch in batches:
        x, y = (_codes(batch.column(k), SLOTS) for k in (2, 3))
        enough = (x == y).sum(axis=1) >= LEAST_AGREEMENT
        yield batch.select([0, 1]).filter(pa.array(enough, pa.bool_()))


def _tiles(table: pa.Table) -> pa.Table:
    """Links between different classes, by whole bags, of the two tiles of one group.

    Items that both tiles have are columns of two 0/1 matrices, some at a time; the products of
    their rows add up to the overlaps.
    """
    is_x = table["is_x"].to_numpy(zero_copy_only=False).astype(bool)
    node, kind, main = (table[c].to_numpy() for c in ("node", "kind", "largest"))
    items, starts = _flat(table["items"])
    sizes = np.diff(starts)
    place = np.zeros(len(node), np.int64)
    place[is_x], place[~is_x] = np.arange(is_x.sum()), np.arange((~is_x).sum())
    of_x, row = np.repeat(is_x, sizes), np.repeat(place, sizes)
    _, number = np.unique(items, return_inverse=True)
    count = number.max(initial=-1) + 1
    common = (np.bincount(number[of_x], minlength=count) > 0) & (np.bincount(number[~of_x], minlength=count) > 0)
    column = (np.cumsum(common) - 1)[number]
    kept = common[number]
    of_x, row, column = of_x[kept], row[kept], column[kept]
    order = np.argsort(column, kind="stable")
    of_x, row, column = of_x[order], row[order], column[order]
    overlap = np.zeros((is_x.sum(), (~is_x).sum()), np.float32)
    for low in range(0, int(common.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        x, at, to = of_x[part], row[part], column[part] - low
        left, right = (np.zeros((n, COLUMNS), np.float32) for n in overlap.shape)
        left[at[x], to[x]] = 1
        right[at[~x], to[~x]] = 1
        overlap += left @ right.T
    x, y = np.flatnonzero(is_x), np.flatnonzero(~is_x)
    union = sizes[x][:, None] + sizes[y][None, :] - overlap
    wanted = (kind[y] != kind[x][:, None]) & ((kind[y] == main[y]) | (node[y] < node[x][:, None]))
    i, j = np.nonzero(wanted & (overlap.astype(np.float64) / union >= SIMILARITY))
    a, b = node[x[i]], node[y[j]]
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, words of a, words of b), the pairs at or above the similarity."""
    for batch in batches:
        wa, sa = _flat(batch.column(2))
        wb, sb = _flat(batch.column(3))
        linked, i = [], 0
        while i < batch.num_rows:
            # Pairs up to STEP words, one at least.
            end = int(np.searchsorted(sa + sb, sa[i] + sb[i] + STEP, side="right")) - 1
            j = min(max(i + 1, end), batch.num_rows)
            a, b = sa[i : j + 1], sb[i : j + 1]
            linked.append(overlaps(wa[a[0] : a[-1]], a - a[0], wb[b[0] : b[-1]], b - b[0]) >= SIMILARITY)
            i = j
        enough = np.concatenate(linked) if linked else np.zeros(0, bool)
        yield batch.select([0, 1]).filter(pa.array(enough, pa.bool_()))


def word_hashes(text: Column) -> Column:
    return F.transform(shared.words_of(text), lambda w: F.xxhash64(w))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Class of near duplicates of every row: columns doc_id, class_id (long), kept (boolean).

    Two documents are linked if the bags of their five-word shingles (words are runs of anything but
    ASCII white space, shingles count as often as they occur) have a weighted Jaccard similarity of
    0.8 or more. ``class_id`` is the smallest id reachable by links, the document's own included;
    ``kept`` says that it is the document's own. A text of one to four words is one shingle.

    Documents with equal texts are collapsed first, by a 128-bit digest. BagMinHash signatures of
    192 slots are cut into 32 bands of 6; two documents of similarity 0.8 share a band with a
    probability over 0.9999. Candidates are compared in two rounds. In the first, every document is
    compared with the smallest id of each of its bands' buckets, and what is linked falls into
    classes. In the second, every two documents of a bucket that are still in different classes are
    compared. So no pair that shares a bucket is missed, and a large group of copies does not cost
    its square. Compared means: signatures first, and where 131 of the slots agree, the whole bags.
    In large buckets of documents that are alike, but not enough to be linked, bags are compared in
    tiles of about 1,024 texts; that is the only work that grows with the square of a group.

    NULL and empty texts, and texts without words, link with nothing, not with each other. Rows
    with the same id are one document and get one class: what is near any of its texts is near the document. A row without id gets a NULL class and is
    kept. An empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), shared.text_of(text).alias("text"))
    worded = rows.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(shared.NOT_SPACE))
    digests = pin(worded.select("doc_id", F.md5("text").alias("digest")), "digests")
    nodes = pin(digests.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    signed = worded.select("doc_id", word_hashes(F.col("text")).alias("words"))
    signed = shared.map_arrow(signed, _sign, "node long, bands array<long>, codes binary")
    signed = pin(signed.join(nodes.select("node").distinct(), "node", "left_semi"), "signatures")
    buckets = signed.select("node", F.explode("bands").alias("bucket")).distinct()
    signed = signed.select("node", "codes")
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
    shared_buckets = pin(heads.filter("n > 1"), "heads")
    buckets = pin(buckets.join(shared_buckets, "bucket").select("bucket", "node", "head"), "buckets")

    first = buckets.filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    first = _similar(worded, signed, first.distinct()).union(_same_ids(digests, nodes))
    classes = components(first)
    second = _between_classes(buckets, classes, worded, signed)
    if not second.isEmpty():
        classes = components(first.union(second))

    found = nodes.join(classes, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("root")
    )
    # The texts of an id are in one class, so any of them names it.
    found = pin(found, "classes")
    named = digests.join(found, "digest").groupBy("doc_id").agg(F.min("root").alias("root"))
    named = rows.select("doc_id").join(named, "doc_id", "left")
    class_id = F.coalesce("root", "doc_id")
    return named.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def _same_ids(digests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of each id's texts, where it has several; written."""
    several = digests.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = pin(several.select("doc_id"), "several")
    owned = digests.join(several, "doc_id", "left_semi").join(nodes, "digest").select("doc_id", "node").distinct()
    owned = pin(owned, "owned")
    least = owned.groupBy("doc_id").agg(F.min("node").alias("b"))
    return pin(owned.join(least, "doc_id").select(F.col("node").alias("a"), "b").filter("a != b"), "same_ids")


def _between_classes(
    buckets: DataFrame, classes: DataFrame, texts: DataFrame, signed: DataFrame
) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different classes; written.

    Every member outside the bucket's largest class meets all members of other classes; two members
    of the same class never meet, so a bucket of one large class and few others stays small. Where
    many pairs meet all the same, whole bags are compared tile by tile, and only links become rows.
    """
    placed = buckets.join(classes.withColumnRenamed("root", "kind"), "node", "left")
    placed = pin(placed.select("bucket", "node", F.coalesce("kind", "node").alias("kind")), "placed")
    sizes = placed.groupBy("bucket", "kind").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("bucket").agg(
        F.max_by("kind", F.struct("n", "kind")).alias("largest"),
        F.sum("n").alias("n"),
        (F.sum("n") - F.max("n")).alias("few"),
    )
    mixed = pin(placed.join(sizes.filter("few > 0"), "bucket"), "mixed")
    small = mixed.filter(F.col("few") * F.col("n") <= SMALL_BUCKET)
    x = small.filter("kind != largest").select("bucket", F.col("node").alias("x"), F.col("kind").alias("x_kind"))
    pairs = x.join(small, "bucket").filter("kind != x_kind and (kind = largest or node < x)")
    pairs = pairs.select(F.greatest("x", "node").alias("a"), F.least("x", "node").alias("b")).distinct()
    large = mixed.filter(F.col("few") * F.col("n") > SMALL_BUCKET).drop("n", "few")
    links = _similar(texts, signed, pairs).union(_tile_links(pin(large, "large"), texts))
    return pin(links.distinct(), "second")


def _tile_links(large: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between classes in large buckets (bucket, node, kind, largest)."""
    ids = pin(large.select(F.col("node").alias("doc_id")).distinct(), "ids")
    bag = _texts_of(texts, ids)
    bag = bag.select("doc_id", word_hashes(F.col("text")).alias("words"))
    bag = pin(shared.map_arrow(bag, _items, "node long, items array<long>"), "items")
    outside = F.col("kind") != F.col("largest")
    weight = F.size("items").cast("long")
    members = large.join(bag.select("node", weight.alias("w")), "node")

    def tiles(n: Column, w: Column) -> Column:
        return F.greatest(F.ceil(n / TILE), F.ceil(w / TILE_SHINGLES), F.lit(1)).cast("long")

    counts = members.groupBy("bucket").agg(
        tiles(F.count_if(outside), F.sum(F.when(outside, F.col("w")))).alias("x_tiles"),
        tiles(F.count(F.lit(1)), F.sum("w")).alias("y_tiles"),
    )
    large = large.join(pin(counts, "tiles"), "bucket")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        every = F.sequence(F.lit(0).cast("long"), F.col(f"{other}_tiles") - 1)
        mine = F.pmod(F.xxhash64("node", F.lit(own)), f"{own}_tiles").alias(own)
        return rows.select("bucket", "node", "kind", "largest", F.lit(own == "x").alias("is_x"), mine, F.explode(every).alias(other))

    both = dealt(large.filter(outside), "x", "y").unionByName(dealt(large, "y", "x"))
    both = both.join(bag, "node").select("bucket", "x", "y", "is_x", "node", "kind", "largest", "items")
    shared.ship(large.sparkSession)
    return both.groupBy("bucket", "x", "y").applyInArrow(_tiles, "a long, b long")


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Every different text of the ids: doc_id, text."""
    needed = texts.join(ids, "doc_id", "left_semi").groupBy("doc_id", F.md5("text").alias("digest"))
    return needed.agg(F.any_value("text").alias("text")).drop("digest")


def _similar(texts: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those at or above the similarity; written."""
    near = pairs.join(signed.toDF("a", "x"), "a").join(signed.toDF("b", "y"), "b")
    near = shared.map_arrow(near.select("a", "b", "x", "y"), _agree, "a long, b long")
    near = pin(near.distinct(), "candidates")
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b"))
    # Written, so that Spark knows whether the ids are few enough to broadcast instead of the texts.
    needed = _texts_of(texts, pin(ids.distinct(), "ids"))
    needed = pin(needed.select("doc_id", word_hashes(F.col("text")).alias("words")), "words")
    both = near.join(needed.toDF("a", "wa"), "a").join(needed.toDF("b", "wb"), "b")
    both = both.select("a", "b", "wa", "wb")
    return pin(shared.map_arrow(both, _verify, "a long, b long"), "similar")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The table without near duplicates: of each class one row stays, that of the smallest id.

    Rows that repeat an id are reduced to one; rows without id stay.
    """
    classes = near_duplicates(docs, doc_id, text).filter(F.col("doc_id").isNotNull())
    ids = classes.groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = pin(ids.filter("not kept or n > 1").select(F.col("doc_id").alias("id"), "kept"), "gone")
    rows = shared.with_row(docs, id=F.col(doc_id).cast("long"))
    single = rows.join(gone, "id", "left_anti")
    repeated = rows.join(gone.filter("kept").select("id"), "id", "left_semi").dropDuplicates(["id"])
    return shared.rows_back(single.unionByName(repeated))
