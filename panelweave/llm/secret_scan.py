"""Secrets in texts: fixed patterns, and strings that nothing around them explains."""

from __future__ import annotations

import bisect
import itertools
import random
import re
import string
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import shared

# The kinds in their order, and what each looks like.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# Words that announce something secret, and what may be one.
CONTEXT_WORDS = (
    "auth", "bearer", "cookie", "credential", "passphrase", "password", "passwd", "private", "pwd",
    "secret", "session", "signature", "token", "apikey", "api_key", "access_key", "accesskey",
)
CONTEXT = re.compile("|".join(CONTEXT_WORDS), re.ASCII | re.IGNORECASE)
# Without other letters than hexadecimal digits.
HEX_FORM = re.compile(r"[^g-zG-Z]+")
# Runs of the characters of keys; "=" only pads, so that it parts a name from its value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/][A-Za-z0-9+/_.-]{14,}[A-Za-z0-9+/_-]={0,2}")
# Where a statement ends, and with it what its words announce.
STATEMENT_END = re.compile(r"\n|[.!?;](?=\s)")
# Code points on each side of a string that are compressed with it.
AROUND = 2_000
# A string is novel if it adds so large a part of the bytes that random strings of its form add, the mean of so many.
LEAST_NOVELTY = 0.8
SCRAMBLED = 3

# Identifiers common in public code, the base of the dictionary.
IDENTIFIERS = (
    "accept access account action address admin algorithm append application argument array assert async "
    "attribute authorization await backend base64 batch begin binary boolean branch bucket buffer build "
    "cache callback catch certificate channel character charset checksum class client close cluster code "
    "collection column command commit common component config connect const constructor container content "
    "context continue control cookie copy count create credential current cursor data database datetime "
    "debug decode default define delete deploy description destination device dict digest directory disable "
    "document domain double download driver email enable encode encrypt endpoint entry enum environment "
    "error event except exception execute export expression extends false fetch field file filter final "
    "finally float folder format from function generate global group handle handler hash header height host "
    "html http https identifier image implements import include index info init input insert install "
    "instance integer interface internal item iterator json key label lambda language length level library "
    "limit list listener load local location logger login main manager map master message metadata method "
    "model module name namespace network node none null number object offset open operation option order "
    "output package page param parameter parent parse password path pattern payload permission platform "
    "plugin policy port post prefix primary print private process production profile project property "
    "protected protocol provider proxy public query queue random range read record redirect reference "
    "region register release remote remove render replace request require reset resource response result "
    "return role root route runtime schema scope script search secret section select self send server "
    "service session setting shared signature size socket source start state static status storage stream "
    "string struct submit success super switch sync system table target task template test text thread "
    "throw timeout timestamp title token trace transaction transform true type undefined union unique "
    "update upload url user username utf-8 valid value variable vector verify version view void volume "
    "warning while width window worker write yaml yield"
)


def primed_compressor(strings: Iterable[str] = ()) -> zstandard.ZstdCompressor:
    """A compressor that knows the identifiers of public code, and ``strings``."""
    content = "\n".join([*strings, IDENTIFIERS]).encode()
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=known)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; leftmost matches of each kind, failing ones dropped."""
    spans = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def scrambled(text: str, rng: random.Random) -> str:
    """Random characters in the form of ``text``: each of the same kind, of hexadecimal ones if it has no others."""
    lower = "abcdef" if HEX_FORM.fullmatch(text) else string.ascii_lowercase

    def another(c: str) -> str:
        if c.isdigit():
            return rng.choice(string.digits)
        if c.islower():
            return rng.choice(lower)
        return rng.choice(lower).upper() if c.isupper() else c

    return "".join(map(another, text))


def novelty(text: str, start: int, end: int, compressor: zstandard.ZstdCompressor) -> float:
    """Bytes that ``text[start:end]`` adds to its surroundings, as a part of those that random strings of its form add.

    The surroundings are 2,000 code points on each side, without other copies of the string, so that a key given
    twice does not explain itself. What lies further away explains a string through the compressor's dictionary.
    Random strings take the place of the string in the same surroundings; they depend on the string alone.
    """
    found = text[start:end]
    before = text[max(0, start - AROUND) : start].replace(found, "")
    after = text[end : end + AROUND].replace(found, "")

    def size(middle: str) -> int:
        return len(compressor.compress((before + middle + after).encode()))

    rng = random.Random(found)
    rest = size("")
    expected = sum(size(scrambled(found, rng)) - rest for _ in range(SCRAMBLED)) / SCRAMBLED
    return (size(found) - rest) / max(1, expected)


def announced(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the candidates after an announcing word of the same statement, outside ``base``.

    A word within a base span announces only that. A statement ends with its line, or at ``.``, ``!``, ``?`` or ``;``
    before white space; it may be of any length.
    """
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, _, e in base), max))

    def free(start: int, end: int) -> bool:
        before = bisect.bisect_left(starts, end)
        return before == 0 or reach[before - 1] <= start

    found, done = [], 0
    for word in CONTEXT.finditer(text):
        if word.end() < done or not free(word.start(), word.end()):
            continue
        stop = STATEMENT_END.search(text, word.end())
        done = stop.start() if stop else len(text)
        for m in CANDIDATE.finditer(text, word.end(), done):
            if free(m.start(), m.end()):
                found.append((m.start(), m.end()))
    return found


def without(text: str, strings: Iterable[str]) -> str:
    """``text`` with a line end for each occurrence of one of ``strings``, the longest first, inside words too."""
    search = ahocorasick.Automaton()
    for found in strings:
        search.add_word(found, len(found))
    search.make_automaton()
    rest, at = [], 0
    for last, length in search.iter_long(text):
        rest.append(text[at : last + 1 - length])
        at = last + 1
    return "\n".join([*rest, text[at:]])


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, 3, end) of strings that a word announces as secret and nothing explains, outside ``base``.

    A candidate is a run of 16 or more of the characters of keys, whatever their kind, after an announcing word in the
    same statement. It is reported if compressing it adds 80 % or more of the bytes that random strings of its form add
    to its surroundings. The dictionary holds identifiers of public code and all other long strings of the
    whole text. Work is in proportion to the text and to its candidates.
    """
    places = announced(text, base)
    if not places:
        return []
    others = CANDIDATE.findall(without(text, {text[s:e] for s, e in places}))
    compressor = primed_compressor(dict.fromkeys(others))
    return [(s, 3, e) for s, e in places if novelty(text, s, e, compressor) >= LEAST_NOVELTY]


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every row's whole text: doc_id, spans (array of struct kind, start, end).

    Kinds assign, access and hex are fixed patterns; novel ones are found by compression (see
    :func:`novel_spans`) and never touch the others. Spans count code points, the end exclusive, and
    come by start, then kind. NULL reads as empty; an empty text has no spans. Repeated rows come out as
    often as they came; an empty table gives an empty table; other columns are not read. One pass,
    no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for value in batch.column(1):
                content = value.as_py()
                base = base_spans(content)
                every = sorted(base + novel_spans(content, base))
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            column = pa.array(
                spans,
                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), shared.text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return shared.map_arrow(rows, 
        run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
        ),
        ",",
    )
