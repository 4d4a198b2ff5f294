"""Quality classifier: an additive model of binned features and pairs of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared
from panelweave.llm.shared import let
from panelweave.sources.workspace import pin

# Bound on the labelled rows that the model is fitted on, chosen by a hash of the id.
SAMPLE = 20_000
BINS = 32
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.15
LEAVES = 3
LEAST_ROWS = 5
FOLDS = 5

FEATURES = (
    "log_words",
    "word_length",
    "symbols",
    "capitals",
    "digits",
    "wordless",
    "distinct_words",
    "exclamations",
    "stops",
    "repeated_lines",
    "log_line_words",
    "long_words",
)


def features(text: Column) -> Column:
    """Struct of the model's features of a text, all doubles; 0 where a text has nothing to count."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    def of(words: Column) -> Column:
        n, chars = F.size(words), F.length(F.array_join(words, ""))
        lines = F.filter(shared.lines_of(text), lambda x: x.rlike(shared.NOT_SPACE))
        # Words without a letter or digit, and words over 12 characters.
        bare = F.size(F.filter(words, lambda w: ~w.rlike(r"[\p{L}\p{N}]")))
        long = F.size(F.filter(words, lambda w: F.length(w) > 12))
        distinct = F.size(F.array_distinct(words))
        return let(
            lines,
            lambda x: F.struct(
                F.log1p(n).alias("log_words"),
                share(chars, n).alias("word_length"),
                share(count(r"[#*$%&|<>]"), n).alias("symbols"),
                share(count(r"\p{Lu}"), chars).alias("capitals"),
                share(count(r"\p{Nd}"), chars).alias("digits"),
                share(bare, n).alias("wordless"),
                # Long texts repeat words more: compare with the square root of their number.
                share(distinct, F.sqrt(n.cast("double"))).alias("distinct_words"),
                share(count(r"[!?]"), n).alias("exclamations"),
                share(count(r"[.,;:]"), n).alias("stops"),
                share(F.size(x) - F.size(F.array_distinct(x)), F.size(x)).alias("repeated_lines"),
                F.log1p(share(n, F.size(x))).alias("log_line_words"),
                share(long, n).alias("long_words"),
            ),
        )

    return let(shared.words_of(text), of)


@dataclass
class AdditiveModel:
    """Lookup tables over feature bins; the sum of a row's entries is the log-odds of label 1."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        odds = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            odds += table[b[k]]
        for i, j, table in self.pairs:
            odds += table[b[i], b[j]]
        return 1 / (1 + np.exp(-odds))


def _steps(gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over ordered bins: the best cuts one after another, a Newton step per leaf."""

    def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + 1.0)

    spans = [(0, len(gradient))]
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            g, h, n = (np.cumsum(x[a:b]) for x in (gradient, hessian, rows))
            if b - a < 2:
                continue
            better = gain(g[:-1], h[:-1]) + gain(g[-1] - g[:-1], h[-1] - h[:-1]) - gain(g[-1], h[-1])
            better[(n[:-1] < LEAST_ROWS) | (n[-1] - n[:-1] < LEAST_ROWS)] = 0
            k = int(np.argmax(better))
            if better[k] > best[0]:
                best = (better[k], s, a + k + 1)
        if best[1] is None:
            break
        a, b = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in spans:
        out[a:b] = gradient[a:b].sum() / (hessian[a:b].sum() + 1.0)
    return out


def _corners(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features: its gain, and its step for each cell."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    total_g, total_h = cg[-1, -1], ch[-1, -1]
    low, high = slice(1, -1), slice(-1, None)

    def quarters(c: np.ndarray, total: float) -> list[np.ndarray]:
        inner, rows, columns = c[low, low], c[low, high], c[high, low]
        return [inner, rows - inner, columns - inner, total - rows - columns + inner]

    gains = sum(a * a / (b + 1.0) for a, b in zip(quarters(cg, total_g), quarters(ch, total_h), strict=True))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    step = np.zeros_like(g)
    for a in (slice(0, i + 1), slice(i + 1, None)):
        for b in (slice(0, j + 1), slice(j + 1, None)):
            step[a, b] = g[a, b].sum() / (h[a, b].sum() + 1.0)
    return float(gains[i, j] - total_g**2 / (total_h + 1.0)), step


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: in every round each feature in turn gets one small step, then pairs do.

    The pairs are those whose two-cut tree explains most of what the single features leave.
    Without rows of both labels the score is the share of label 1 (smoothed).
    """
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = AdditiveModel(edges)
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    odds = np.full(len(y), model.intercept)
    counts = [np.bincount(b[k], minlength=len(t)) for k, t in enumerate(model.tables)]

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = residual()
            sums = [np.bincount(b[k], v, minlength=len(table)) for v in (g, h)]
            step = RATE * _steps(*sums, counts[k], LEAVES)
            table += step
            odds += step[b[k]]

    def cells(i: int, j: int) -> list[np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        at = b[i] * shape[1] + b[j]
        return [np.bincount(at, v, minlength=shape[0] * shape[1]).reshape(shape) for v in residual()]

    wide = [k for k, t in enumerate(model.tables) if len(t) > 1]
    ranked = sorted(((_corners(*cells(i, j))[0], i, j) for i, j in combinations(wide, 2)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _corners(*cells(i, j))[1]
            table += step
            odds += step[b[i], b[j]]
    return model


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's text modulo five; a NULL id reads as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> AdditiveModel:
    """Fit on labelled documents outside fold 0, ``sample`` rows at most, chosen by a hash of the id.

    Labels that are NULL or of unknown documents are not used; of several for one id the largest counts.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter((F.col("label").isNotNull()) & (fold_of(F.col("id")) != 0))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = pin(known.orderBy(F.xxhash64("id"), "id").limit(sample), "labels")
    rows = docs.select(F.col(doc_id).alias("id"), shared.text_of(text).alias("text")).join(chosen, "id")
    rows = rows.select("id", "label", features(F.col("text")).alias("f"))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("label", "f.*").toPandas()
    return fit(rows[list(FEATURES)].to_numpy(np.float64), rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: AdditiveModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every row's whole text between 0 and 1: doc_id, score.

    NULL reads as empty, and empty texts are scored like others. Repeated rows come out as often as
    they came; an empty table gives an empty table; other columns are not read. Features are
    computed in the JVM, so only numbers go to Python; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), features(shared.text_of(text)).alias("f"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return shared.map_arrow(rows.select("doc_id", "f.*"), run, f"doc_id {kind}, score double")
