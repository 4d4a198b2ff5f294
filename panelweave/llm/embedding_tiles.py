"""Near-duplicate vectors by products of quantised tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared
from panelweave.llm.components import components
from panelweave.sources.workspace import pin

COSINE = 0.93
TILE = 1024
# Pairs that one step computes again in full precision.
EXACT_STEP = 100_000
# Covers the rounding of the bounds themselves.
ROUNDING = 1e-9


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of the vectors' directions, the scale of each, and the length of what is lost."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(units - codes * scale[:, None], axis=1)
    return codes, scale, lost


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, cosine: float = COSINE) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have at least this cosine, exactly; ``same``: a is b.

    With u = s q + e, the product of two directions differs from s q . s' q' by at most
    |e'| + |e| (1 + |e'|). Pairs decided by that bound are not looked at again; the others are
    computed in double precision. Products of int8 codes stay below 2**24 for up to 1,000
    components, so single precision adds them exactly; longer vectors use double precision.
    """
    qa, sa, ea = quantise(a)
    qb, sb, eb = (qa, sa, ea) if same else quantise(b)
    exact = np.float32 if a.shape[1] <= 1000 else np.float64
    product = (qa.astype(exact) @ qb.astype(exact).T).astype(np.float64) * np.outer(sa, sb)
    slack = ea[:, None] * (1 + eb[None, :]) + eb[None, :] + ROUNDING
    linked = product - slack >= cosine
    i, j = np.nonzero(~linked & (product + slack >= cosine))
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for k in range(0, len(i), EXACT_STEP):
        x, y = i[k : k + EXACT_STEP], j[k : k + EXACT_STEP]
        linked[x, y] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= cosine
    if same:
        linked |= linked.T
        np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``linked`` connects, one at most for each node: (node, its root)."""
    big = np.iinfo(np.int64).max
    roots_a, roots_b = a.copy(), b.copy()
    while True:
        new_b = np.minimum(roots_b, np.where(linked, roots_a[:, None], big).min(axis=0, initial=big))
        new_a = np.minimum(roots_a, np.where(linked, new_b[None, :], big).min(axis=1, initial=big))
        if (new_a == roots_a).all() and (new_b == roots_b).all():
            break
        roots_a, roots_b = new_a, new_b
    node, root = np.concatenate([a, b]), np.concatenate([roots_a, roots_b])
    return node[node != root], root[node != root]


def _tile_pair(table: pa.Table) -> pa.Table:
    """Links counted, and a forest of them, between the two tiles of one group."""
    side = table["side"].to_numpy()
    nodes, copies = table["node"].to_numpy(), table["copies"].to_numpy()
    values = table["vector"].combine_chunks()
    vectors = values.values.to_numpy(zero_copy_only=False).reshape(len(side), -1)
    first, second = side == table["first"][0].as_py(), side == table["second"][0].as_py()
    same = bool((first == second).all())
    a, b = nodes[first], nodes[second]
    linked = tile_links(vectors[first], vectors[second], same)
    counted = [(a, linked @ copies[second])] + ([] if same else [(b, copies[first] @ linked)])
    ids = np.concatenate([x[n > 0] for x, n in counted])
    links = np.concatenate([n[n > 0] for _, n in counted]).astype(np.int64)
    node, root = _forest(linked, a, b)
    parts = [
        {"node": ids, "links": links, "root": pa.nulls(len(ids), pa.int64())},
        {"node": node, "links": np.zeros(len(node), np.int64), "root": root},
    ]
    return pa.concat_tables([pa.table(part) for part in parts])


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction: no NULL or non-finite component, not all zero."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """Links and component of every row: vec_id, n_links, component_id (long), kept (boolean).

    Two vectors are linked if their labels are equal and not NULL, their lengths are equal, and the
    cosine in double precision is 0.93 or more. ``n_links`` counts the other rows linked directly;
    ``component_id`` is the smallest id reachable by links, the row's own included; ``kept`` says
    that it is the row's own.

    Equal vectors of a label are one node with a number of copies. A label's nodes are dealt out by
    a hash into tiles of about 1,024, and every two tiles meet in one group of bounded size, where
    links are counted and only a forest of them, at most one link a node, is returned. So nothing
    grows with the number of links, but tiles of a label meet pairwise: work and shuffle grow with
    its nodes times its tiles, as comparing everything with everything does.

    Vectors that are NULL, zero, or hold NULL or non-finite components link with nothing. Rows that
    repeat an id are one document: they get the links and the component of all its rows together. Rows
    without id link with nothing and have no component, and ``kept`` is true. An empty table
    gives an empty table; other columns are not read.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).alias("label"),
        F.col(embedding).cast("array<double>").alias("vector"),
    )
    usable = rows.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector"))
    )
    # Zero of either sign is one number, also in the digest.
    usable = usable.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    usable = usable.withColumn("direction", F.sha2(F.to_json(F.struct("label", "vector")), 256))
    members = pin(usable.select("vec_id", "direction"), "members")
    nodes = usable.groupBy("direction").agg(
        F.min("vec_id").alias("node"),
        F.count(F.lit(1)).alias("copies"),
        F.first("label").alias("label"),
        F.first("vector").alias("vector"),
    )
    nodes = pin(nodes.withColumn("length", F.size("vector")), "vectors")
    kinds = nodes.groupBy("label", "length").agg(
        F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("tiles")
    )
    tiled = nodes.join(pin(kinds, "kinds"), ["label", "length"])
    tiled = tiled.withColumn("side", F.pmod(F.xxhash64("node", "direction"), "tiles"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.select(
        "label",
        "length",
        F.least("side", "other").alias("first"),
        F.greatest("side", "other").alias("second"),
        "side",
        "node",
        "copies",
        "vector",
    )
    shared.ship(vectors.sparkSession)
    found = tiled.groupBy("label", "length", "first", "second").applyInArrow(
        _tile_pair, "node long, links long, root long"
    )
    found = pin(found, "tile_links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("direction", "node", "copies")
    placed = placed.join(counts, "node", "left").join(roots, "node", "left")
    placed = placed.select(
        "direction",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("root", "node").alias("root"),
    )
    known = members.distinct().join(pin(placed, "placed"), "direction").groupBy("vec_id")
    known = known.agg(F.sum("n").alias("n"), F.min("root").alias("root"))
    every = rows.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return every.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
