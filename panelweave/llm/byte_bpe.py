"""Byte-level BPE in linear time, from a rank file."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared

# Pieces of up to so many bytes are remembered, so many of them, in each Python worker.
PIECE_BYTES = 48
PIECES = 100_000
PAIRS = 1 << 17
BATCH_CHARS = 4_000_000
BASE = -1  # when a single byte came to be


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class ByteBPE:
    """Encoder and decoder for one rank file.

    A piece is encoded from the left by the longest token that matches; an automaton over the
    vocabulary, with bytes written as Latin-1 characters, finds these in one pass. A token may
    follow another if merging the bytes of both would give just these two. Where one does not fit,
    the next shorter one is tried, and without any the last token is taken back; a position found to
    lead nowhere is marked, so each is given up once at most.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            if len(token) > 1 and (halves := self._halves(token)):
                self.halves[rank] = halves
                self.merged[halves] = rank
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        reachable = {t: r for t, r in ranks.items() if len(t) == 1 or r in self.halves}
        for token, rank in reachable.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.reachable = reachable if len(reachable) < len(ranks) else ranks
        self.longest = max(map(len, reachable))
        self.shorter = {
            rank: next((reachable[t] for n in range(len(token) - 1, 0, -1) if (t := token[:n]) in reachable), None)
            for token, rank in reachable.items()
        }
        self.fits = lru_cache(PAIRS)(self._fits)

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that ``token`` is merged from; None if merging never makes it."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(
                ((ranks.get(a + b, len(ranks) + 256), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            )
            if best >= ranks[token]:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves these two.

        Undo their merges at the common edge, the latest first. A merge across the edge would have
        come first if it is earlier than the one just undone; of equal merges the left one comes
        first.
        """
        limit, merged, halves = None, self.merged, self.halves
        while True:
            across = merged.get((left, right))
            if across is not None and (limit is None or across < limit):
                return False
            left_made = left if left in halves else BASE
            right_made = right if right in halves else BASE
            if left_made == right_made == BASE:
                return True
            if left_made > right_made:
                limit, left = left, halves[left][1]
            else:
                limit, right = right + 1, halves[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, shorter, fits = self.size, self.shorter, self.fits
        text = piece.decode("latin-1")
        out: list[int] = []
        at = 0
        for end, token in self.automaton.iter_long(text):
            if out and not fits(out[-1], token):
                break
            out.append(token)
            at = end + 1
        else:
            return out
        dead = bytearray(len(piece) + 1)
        token = shorter[token]
        while at < len(piece):
            while token is not None:
                if not dead[at + size[token]] and (not out or fits(out[-1], token)):
                    break
                token = shorter[token]
            if token is None:
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                token = shorter[last]
            else:
                out.append(token)
                at += size[token]
                token = self._longest(piece, text, at)
        return out

    def _longest(self, piece: bytes, text: str, at: int) -> int | None:
        """The longest token that ``piece``, as ``text`` in Latin-1, has at a place; None at its end."""
        n = self.automaton.longest_prefix(text[at : at + self.longest])
        while n and (token := self.reachable.get(piece[at : at + n])) is None:
            n -= 1
        return token if n else None

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Remembered(dict):
    """Results of a function for short pieces, as many of the first ones as are allowed.

    Frequent pieces come early, so few calls are repeated once it is full.
    """

    def __init__(self, function: Callable[[str], bytes]):
        super().__init__()
        self.function = function

    def __missing__(self, piece: str) -> bytes:
        result = self.function(piece)
        if len(self) < PIECES and len(piece) <= PIECE_BYTES:
            self[piece] = result
        return result


@lru_cache(1)
def _class_spans() -> dict[str, list[tuple[int, int]]]:
    r"""First and last code points of the ranges of \p{L}, \p{N} and \s as the tokenizer library has them."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    classes = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = tiktoken.Encoding("class", pat_str=name + "+", mergeable_ranks=single, special_tokens={})
        codes = [ord(c) for c in bytes(found.encode_ordinary(every)).decode()]
        spans: list[tuple[int, int]] = []
        for c in codes:
            if spans and spans[-1][1] == c - 1:
                spans[-1] = spans[-1][0], c
            else:
                spans.append((c, c))
        classes[name] = spans
    return classes


def python_pattern(pattern: str, last: int = 0x10FFFF) -> re.Pattern:
    r"""``pattern`` for Python's ``re``, with \p{L}, \p{N} and \s as the tokenizer library has them.

    The library's own Unicode tables decide which characters these are, so that texts are cut as
    there whatever the version of Python's tables. The pattern is for texts of code points up to ``last``.
    """
    classes = {
        name: "".join(f"\\U{a:08x}-\\U{min(b, last):08x}" for a, b in spans if a <= last)
        for name, spans in _class_spans().items()
    }
    # A class inside brackets stands as it is, one outside gets brackets of its own.
    pattern = pattern.replace(r"\S", "[^" + classes[r"\s"] + "]")
    out, inside = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\s|\[|\])", pattern):
        if part in ("[", "]"):
            inside = part == "["
            out.append(part)
        elif part in classes:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        else:
            out.append(part)
    return re.compile("".join(out))


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """Function that gives all matches of ``pattern`` in a text.

    Python's ``re`` has a table of a class up to U+FFFF and tries the ranges beyond one by one, for every
    character that is not in the class. So texts without characters beyond are cut by a pattern without those ranges.
    """
    short, whole = python_pattern(pattern, 0xFFFF), python_pattern(pattern)
    beyond = re.compile("[\U00010000-\U0010ffff]")
    return lambda text: (whole if beyond.search(text) else short).findall(text)


@lru_cache(2)
def _encoder(path: str, pattern: str) -> tuple[ByteBPE, Callable[[str], list[str]], Remembered]:
    """Encoder, cutter, and ids of a piece as four bytes each; built once in each Python worker."""
    bpe = ByteBPE(read_ranks(path))

    def packed(piece: str) -> bytes:
        return array("i", bpe.encode_piece(piece.encode())).tobytes()

    return bpe, cutter(pattern), Remembered(packed)


@lru_cache(2)
def _token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _lists(values: list[bytes], item: pa.DataType) -> pa.ListArray:
    """List column of four-byte numbers from their bytes."""
    starts = [0]
    for v in values:
        starts.append(starts[-1] + len(v) // 4)
    data = pa.py_buffer(b"".join(values))
    items = pa.Array.from_buffers(item, starts[-1], [None, data])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), items)


def _slices(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch up to ``most`` in all, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """Token ids of every row's whole text: columns doc_id, ids (array of int).

    ``path`` is a rank file that every executor has; each match of ``pattern`` is encoded
    separately, without special tokens, and the ids are those of the tiktoken library. With ``decoded``,
    the column decoded has the bytes that the ids stand for, as from :func:`decode` but in the same
    Python worker. NULL and empty texts have no ids. Repeated rows come out as often as they came; an
    empty table gives an empty table; other columns are not read. One pass, no shuffle; a batch is cut into parts of a few
    million characters, and what a worker remembers of earlier pieces is bounded and forgotten after each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cut, remembered = _encoder(path, pattern)
        packed = remembered.__getitem__
        try:
            for batch in batches:
                for part in _slices(batch, batch.column(2).to_pylist(), BATCH_CHARS):
                    ids = [b"".join(map(packed, cut(t.as_py()))) for t in part.column(1)]
                    columns = [part.column(0), _lists(ids, pa.int32())]
                    if decoded:
                        columns.append(_decoded(columns[1], bpe.bytes_of))
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            # The worker lives on, in later stages too; what was remembered is of no use there.
            remembered.clear()
            bpe.fits.cache_clear()

    content = shared.text_of(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), content.alias("text"), F.length(content).alias("n"))
    names = ["doc_id", "ids", "decoded"][: 2 + decoded]
    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = [f"doc_id {kind}", "ids array<int>", "decoded binary"][: 2 + decoded]
    return shared.map_arrow(rows, run, ", ".join(kinds))


def _decoded(ids: pa.ListArray, token: dict[int, bytes]) -> pa.Array:
    ends, values = ids.offsets.to_pylist(), ids.values.to_numpy()
    done = [
        b"".join(map(token.__getitem__, values[a:b].tolist())) for a, b in zip(ends, ends[1:], strict=False)
    ]
    return pa.array(done, pa.binary())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (binary), the bytes that ``ids`` stand for; columns doc_id, ids, decoded.

    No ids, or NULL, decode to nothing; an id that the rank file lacks is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _token_bytes(path)
        for batch in batches:
            for part in _slices(batch, batch.column(2).to_pylist(), BATCH_CHARS):
                columns = [part.column(0), part.column(1), _decoded(part.column(1), token)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n"))
    return shared.map_arrow(rows, run, f"doc_id {kind}, ids array<int>, decoded binary")
