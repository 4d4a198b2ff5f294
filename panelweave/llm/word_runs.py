"""Periodic runs of words, found by internal pattern matching.

A run of period p and at least 4 p words contains, wherever it begins, a block of 2**k words (2**(k-1) < p <= 2**k)
that starts at a multiple of 2**(k-1) and whose next occurrence is p words on: a block no shorter than the smallest
period occurs inside the run at distances that are multiples of p only. So each such block asks for
its next occurrence in the window that follows it. Blocks of four words serve all periods up to four, because the
shortest run has six words.

Occurrences of a block are an interval of the suffix array; the next one is a range successor, answered by a
wavelet tree over the array. The occurrence and the block start an arithmetic progression whose difference is the candidate
period. Candidates of one period that overlap by a period are one stretch, extended word by word to its ends.

Many documents are searched at once. Words of different documents count as different, so no block occurs in two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared

# Documents are searched together up to so many words; a longer one is searched alone.
TOGETHER = 1 << 18
LEAST_WORDS = 6
LEAST_PERIODS = 4
FIRST_BLOCK = 4


class WaveletTree:
    """The numbers 0 to n - 1 in some order; answers which is the smallest above a bound in an interval."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.levels = []
        for bit in reversed(range(max(1, (self.size - 1).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            zeros_before = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros_before))
            values = np.concatenate([values[~ones], values[ones]])

    def count_below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values at places ``low`` to ``high`` (exclusive) are below ``bound``."""
        count = np.zeros(len(low), np.int64)
        for bit, zeros_before in self.levels:
            one = (bound >> bit & 1).astype(bool)
            low0, high0, zeros = zeros_before[low], zeros_before[high], zeros_before[-1]
            count += np.where(one, high0 - low0, 0)
            low = np.where(one, zeros + low - low0, low0)
            high = np.where(one, zeros + high - high0, high0)
        return count

    def quantile(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of this rank, from 0, among those at places ``low`` to ``high`` (exclusive)."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros_before in self.levels:
            low0, high0, zeros = zeros_before[low], zeros_before[high], zeros_before[-1]
            one = rank >= high0 - low0
            rank = np.where(one, rank - (high0 - low0), rank)
            value |= one.astype(np.int64) << bit
            low = np.where(one, zeros + low - low0, low0)
            high = np.where(one, zeros + high - high0, high0)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The smallest value above ``after`` among those at the places, or -1."""
        found = np.full(len(low), -1, np.int64)
        some = np.flatnonzero(after + 1 < self.size)
        rank = self.count_below(low[some], high[some], after[some] + 1)
        inside = rank < high[some] - low[some]
        some, rank = some[inside], rank[inside]
        found[some] = self.quantile(low[some], high[some], rank)
        return found


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys in their order, and how often each number occurs."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return names, counts


def _candidates(words: np.ndarray, docs: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each length of block: places of blocks that occur again in the window after them, how far on, the length.

    ``words`` holds the words of several documents, each followed by one number that no word has;
    ``docs`` says which document a place belongs to.
    """
    size, kinds = len(words), int(words.max()) + 1
    single = docs * kinds + words
    if float(docs[-1] + 1) * kinds * kinds > 2**62:
        single, _ = _names(single)
    # Two words, then four; only blocks found twice in their document are of interest.
    pairs, counts = _names(single[:-1] * kinds + words[1:])
    pairs = np.append(pairs, len(counts))
    places = np.flatnonzero(counts[pairs[:-1]] > 1)
    fours, counts = _names(pairs[places] * (len(pairs) + 1) + pairs[places + 2])
    twice = counts[fours] > 1
    places, fours = places[twice], fours[twice]
    if not len(places):
        return []
    # The suffix array of these places; a place's rank is where the places with the same block begin.
    suffixes = places[np.argsort(fours, kind="stable")]
    rank = np.arange(len(places), len(places) + size)
    open_ = np.arange(len(places))
    fours = np.sort(fours)
    first = np.flatnonzero(np.append(True, fours[1:] != fours[:-1]))
    sizes = np.diff(np.append(first, len(fours)))
    rank[suffixes] = np.repeat(first, sizes)
    sizes = np.repeat(sizes, sizes)
    asked, block = [], FIRST_BLOCK
    while True:
        at = suffixes[open_]
        aligned = at % (block // 2) == 0
        asked.append((block, at[aligned], rank[at[aligned]], rank[at[aligned]] + sizes[aligned]))
        if LEAST_PERIODS * (block + 1) > longest:
            break
        # Twice the block: by the rank of what follows, within the places that are alike so far.
        group, follow = rank[at], rank[at + block]
        order = np.lexsort((follow, group))
        at, group, follow = at[order], group[order], follow[order]
        suffixes[open_] = at
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
        sizes = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(open_[first], sizes)
        sizes = np.repeat(sizes, sizes)
        again = sizes > 1
        open_, sizes = open_[again], sizes[again]
        block *= 2
        if not len(open_):
            break
    order = np.argsort(suffixes)
    numbers = np.empty(len(suffixes), np.int64)
    numbers[order] = np.arange(len(suffixes))
    tree, in_order, number_of = WaveletTree(numbers), suffixes[order], np.empty(size, np.int64)
    number_of[in_order] = np.arange(len(in_order))
    found = []
    for block, at, low, high in asked:
        following = tree.successor(low, high, number_of[at])
        distance = np.where(following >= 0, in_order[following] - at, 0)
        least = 1 if block == FIRST_BLOCK else block // 2 + 1
        near = (distance >= least) & (distance <= block)
        found.append((at[near], distance[near], block))
    return found


def _equal_words(left: np.ndarray, right: np.ndarray, step: int) -> int:
    """How many leading words are equal, compared in growing pieces."""
    done, most = 0, min(len(left), len(right))
    while done < most:
        same = left[done : min(done + step, most)] == right[done : min(done + step, most)]
        if not same.all():
            return done + int(np.argmin(same))
        done += len(same)
        step *= 2
    return done


def find_runs(words: np.ndarray, docs: np.ndarray, longest: int) -> np.ndarray:
    """Runs as rows (start, length, period), by start and period; ``words`` and ``docs`` as in :func:`_candidates`."""
    runs = set()
    single = docs * (int(words.max()) + 1) + words
    for at, period, block in _candidates(words, docs, longest):
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        end = at + period + block
        apart = (period[1:] != period[:-1]) | (at[1:] + period[1:] > end[:-1])
        first = np.flatnonzero(np.append(True, apart)) if len(at) else []
        last = np.append(first[1:], len(at)) - 1 if len(at) else []
        for a, b, p in zip(at[first].tolist(), end[last].tolist(), period[first].tolist(), strict=True):
            a -= _equal_words(single[:a][::-1], single[: a + p][::-1], 16)
            b += _equal_words(single[b:], single[b - p :], 16)
            if b - a >= max(LEAST_WORDS, LEAST_PERIODS * p):
                runs.add((a, b - a, p))
    return np.array(sorted(runs), np.int64).reshape(-1, 3)


def _searched(texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each text, given as its words, the runs and the words that are kept, joined by blanks."""
    lengths = np.array([len(t) for t in texts])
    starts = np.append(0, np.cumsum(lengths + 1))
    if not lengths.any():
        return [np.empty((0, 3), np.int64) for _ in texts], [b""] * len(texts)
    flat = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy()
    docs = np.repeat(np.arange(len(texts)), lengths + 1)
    words = np.full(starts[-1], flat.max() + 1, np.int64)
    is_word = np.ones(starts[-1], bool)
    is_word[starts[1:] - 1] = False
    words[is_word] = flat
    runs = find_runs(words, docs, int(lengths.max()))
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped) == 0
    cuts = np.searchsorted(runs[:, 0], starts)
    per_text, collapsed = [], []
    for i, text in enumerate(texts):
        own = runs[cuts[i] : cuts[i + 1]] - [starts[i], 0, 0]
        per_text.append(own)
        if len(own):
            text = [text[j] for j in np.flatnonzero(kept[starts[i] : starts[i] + len(text)])]
        collapsed.append(b" ".join(text))
    return per_text, collapsed


def _batch(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    runs, collapsed = _searched(texts)
    offsets = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
    rows = np.concatenate(runs)
    fields = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)]
    columns = {
        "id": ids,
        "n_words": pa.array([len(t) for t in texts], pa.int64()),
        "runs": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
        "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, words, begin = [], 0, 0
        column = batch.column("text")
        for i in range(len(column)):
            # Splits at \x20 and \x09-\x0D, as bytes do.
            text = column[i].as_py().encode().split()
            if texts and words + len(text) > TOGETHER:
                yield _batch(batch.column("id").slice(begin, len(texts)), texts)
                texts, words, begin = [], 0, i
            texts.append(text)
            words += len(text)
        if texts:
            yield _batch(batch.column("id").slice(begin, len(texts)), texts)


def word_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Periodic runs of the words of every text: doc_id, n_words, runs, collapsed.

    Words are what stands between \\x20 and \\x09-\\x0D, numbered from 0. A run is a stretch of words with
    smallest period q (words q apart are equal), of at least 6 and 4 q words, that neither neighbouring word
    extends. ``runs`` lists start, length and period by start, then period. ``collapsed`` joins by blanks
    the words that no run contains after its first q words.

    One row for each row of ``docs``, repeated and NULL ids included. A NULL or empty text has no words, no runs and an empty
    ``collapsed``. Other columns are not read. Memory is in proportion to the longest text.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), shared.text_of(f"`{text}`").alias("text"))
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return shared.map_arrow(rows, _search, schema).withColumnRenamed("id", doc_id)
