"""Sources mixed to target weights by budgets on a tree of groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm import shared
from panelweave.sources.workspace import pin

# Documents of one leaf whose running total one task computes, on average.
DOCS_PER_BUCKET = 10_000
HASH_DIGITS = 8


def word_count(text: str = "text") -> Column:
    return F.size(shared.words_of(shared.text_of(text))).cast("long")


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[tuple, int],
    budget_share: float,
    max_epochs: int,
) -> DataFrame:
    """``leaves`` (levels, supply) with ``budget``: the tokens each leaf is to give.

    From the root down, a node's budget is shared among its children by weight, no child getting
    more than its capacity (supply times ``max_epochs``, summed over its leaves); what one cannot
    take goes to its siblings by weight. As capacities are summed over whole subtrees, a shortage
    leaves a subtree only when all of it is used up, so siblings come before ancestors.

    The share of a full child is its capacity; the others get weight times one rate, which is the
    largest of (budget - capacities of the children before) / (weights of the rest) with children
    in order of capacity / weight. Tokens are whole numbers; shares are rounded down.
    """
    keys = [f"k{i}" for i in range(len(levels))]
    nodes = leaves.select(
        F.lit(0).alias("root"),
        *[F.col(c).alias(k) for c, k in zip(levels, keys, strict=True)],
        "supply",
        (F.col("supply") * max_epochs).alias("capacity"),
    )
    total = F.floor(F.sum("supply").cast("double") * budget_share).cast("long")
    parents = nodes.groupBy("root").agg(F.coalesce(total, F.lit(0)).alias("budget"))
    for depth in range(1, len(levels) + 1):
        path = ["root", *keys[:depth]]
        children = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        children = children.withColumn("weight", _weight(path[1:], weights)).filter("weight > 0")
        children = children.join(parents, path[:-1])
        order = Window.partitionBy(*path[:-1]).orderBy(
            F.col("capacity") / F.col("weight"), path[-1]
        )
        rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        before = F.coalesce(
            F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        rate = (F.col("budget") - before) / F.sum("weight").over(rest)
        children = children.withColumn("rate", rate)
        rate = F.max("rate").over(Window.partitionBy(*path[:-1]))
        share = F.least("capacity", F.floor(F.col("weight") * rate).cast("long"))
        parents = children.select(*path, share.alias("budget"))
    return nodes.join(parents, keys).select(*keys, "supply", "budget")


def _weight(path: Sequence[str], weights: Mapping[tuple, int]) -> Column:
    """Weight of the node at ``path``: as given, 1 where nothing is."""
    weight = F.lit(1).cast("long")
    for names, value in weights.items():
        if len(names) == len(path):
            same = F.lit(True)
            for k, name in zip(path, names, strict=True):
                same = same & (F.col(k) == ("null" if name is None else f"={name}"))
            weight = F.when(same, F.lit(int(value))).otherwise(weight)
    return weight


def mix_to_weights(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[tuple, int],
    budget_share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 0,
    doc_id: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """Rows chosen so that the groups' token counts come as near to their weights as supply allows.

    Columns: row (the whole input row), the names of ``levels`` (the tree, from the top), tokens,
    epoch. ``weights`` maps paths such as ("web", "en") to whole numbers relative to siblings, 1 where not
    given, 0 to leave a node out. The budget is ``budget_share`` of all tokens; see
    :func:`leaf_budgets`. A leaf gives whole epochs of its documents (0, 1, ...) and of the next
    epoch the longest prefix within its budget, in the order of md5(seed:epoch:id). Rows of one leaf
    with equal ids have equal places in that order and come together or not at all.

    NULL is a group of its own; NULL ids read as empty, NULL and empty texts have no tokens. A
    leaf without tokens gives nothing. An empty table gives an empty table. Extra columns stay inside ``row``.
    The prefix of a large leaf is found by sums over ranges of the hash; rows are ordered only
    inside the range where the budget ends. Rows then compare their hash with their leaf's last one,
    so texts are not shuffled as long as the written table of leaves is small enough to broadcast.
    """
    tokens = word_count() if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    keys = [f"k{i}" for i in range(len(levels))]
    coded = {k: shared.null_safe_key(c) for k, c in zip(keys, levels.values(), strict=True)}
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    light = pin(docs.select(
        *[c.alias(k) for k, c in coded.items()], name.alias("name"), tokens.alias("tokens")
    ), "light")
    leaves = light.groupBy(*keys).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("n"))
    leaves = pin(leaves, "leaves")
    budgets = leaf_budgets(leaves.drop("n"), keys, weights, budget_share, max_epochs)
    leaves = leaves.drop("supply").join(budgets.filter("supply > 0"), keys)
    leaves = leaves.withColumn("full", F.expr("budget div supply"))
    leaves = leaves.withColumn("rest", F.expr("budget - full * supply"))
    leaves = leaves.withColumn("ranges", F.ceil(F.col("n") / DOCS_PER_BUCKET).cast("long"))
    leaves = pin(leaves, "budgets")
    leaves = pin(leaves.join(_last_hashes(light, leaves, keys, seed), keys, "left"), "plan")

    working = {"name": name, "tokens": tokens, **coded}
    rows = shared.with_row(docs, **working).join(leaves.select(*keys, "full", "last"), keys)
    taken = F.col("last").isNotNull() & (_hash(seed) <= F.col("last"))
    epochs = F.col("full") + taken.cast("long")
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1))
    value = [
        F.when(F.col(k) != "null", F.substring(k, 2, 2**31 - 1)).alias(c)
        for k, c in zip(keys, levels, strict=True)
    ]
    return rows.filter(epochs > 0).select(shared.ROW, *value, "tokens", epoch.alias("epoch"))


def _hash(seed: int) -> Column:
    """Place of a document within its leaf's next epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("full").cast("string"), F.lit(":"), F.col("name")))


def _last_hashes(light: DataFrame, leaves: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Per leaf the largest hash within the budget of its last epoch; leaves without one are left out."""
    placed = light.join(leaves.select(*keys, "full", "rest", "ranges"), keys)
    placed = placed.withColumn("hash", _hash(seed))
    head = F.conv(F.substring("hash", 1, HASH_DIGITS), 16, 10).cast("long")
    placed = placed.withColumn("range", F.floor(head * F.col("ranges") / 16**HASH_DIGITS))
    sums = placed.groupBy(*keys, "range", "rest").agg(
        F.sum("tokens").alias("sum"), F.max("hash").alias("top")
    )
    order = Window.partitionBy(*keys).orderBy("range")
    sums = pin(sums.withColumn("up_to", F.sum("sum").over(order)), "ranges")
    whole = sums.filter("up_to <= rest").groupBy(*keys).agg(F.max("top").alias("last"))
    # The first range that does not fit, one for each leaf at most.
    cut = sums.filter("up_to > rest and up_to - sum <= rest")
    cut = cut.groupBy(*keys).agg(F.min_by(F.struct("range", F.expr("rest - (up_to - sum)").alias("room")), "range").alias("c"))
    cut = pin(cut.select(*keys, "c.*"), "cut")
    inside = placed.select(*keys, "range", "hash", "tokens").join(cut, [*keys, "range"])
    running = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("hash"))
    part = inside.withColumn("up_to", running).filter("up_to <= room")
    part = part.groupBy(*keys).agg(F.max("hash").alias("last"))
    return whole.union(part).groupBy(*keys).agg(F.max("last").alias("last"))


def mixed_rows(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, int], **options) -> DataFrame:
    """The chosen rows with the columns of ``docs`` only; a row comes once for each of its epochs."""
    return shared.rows_back(mix_to_weights(docs, levels, weights, **options))
