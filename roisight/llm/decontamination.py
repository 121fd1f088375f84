"""Benchmark decontamination with one Aho-Corasick automaton over benchmark word windows.

Texts are normalised by lower-casing A-Z and cutting them into words of digits,
ASCII letters and non-ASCII characters.  Every run of ``width`` words of an item
is a pattern; an item with fewer words, but not none, is one pattern.  The
automaton runs over word numbers, so a document is read once; each hit maps
back to byte or character offsets of the original text.

Memory: the automaton holds at most ``SHARD_WORDS`` item words (or one longer
item).  A larger benchmark is cut into several automata, which are applied one
after the other to ``GATHERED_BYTES`` of documents at a time, and whose hits are
united for each document, so any size gives whole results.  The driver holds one
shard at a time; a Python worker keeps the item texts it was sent.

Defined cases: a null or empty text has no words and no hits; an item without
words or with a null id is left out; repeated documents give a row each;
repeated items count once; an empty benchmark marks nothing; an empty table of
documents gives no rows; a text of any length is scanned whole, in time that
grows with its length and hits; windows that overlap or tie unite in one span;
other columns are not read, whatever their names, but for ``carry``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roisight.llm._text import lean


#: Consecutive words in a window.
WIDTH = 13
#: Item words held by one automaton.
SHARD_WORDS = 2_000_000
#: Bytes of documents that pass through each of several automata before the next is built.
GATHERED_BYTES = 32 << 20

_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or b in _WORD_BYTES else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start:long,end:long>>"
)


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class WindowAutomaton:
    """Aho-Corasick over word numbers; ``hits`` gives covered word ranges and the items found."""

    def __init__(self, items: list[tuple[object, str]], width: int = WIDTH):
        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words(text))
            for k in range(max(len(ids) - width, 0) + 1 if ids else 0):
                patterns.setdefault(ids[k : k + width], set()).add(str(item))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if patterns else None
        for key, found in patterns.items():
            self.machine.add_word(key, (len(key), found))
        if patterns:
            self.machine.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint, sorted [first, end) word ranges inside occurrences, and item ids."""
        if self.machine is None or not words:
            return [], set()
        number = self.numbers.get
        ids = tuple([number(w, 0) for w in words])
        raw, items = [], set()
        for end, (length, found) in self.machine.iter(ids):
            raw.append((end + 1 - length, end + 1))
            items |= found
        return merged(raw), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _spans(text: str, hit: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets of word ranges; normalising keeps byte positions."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    out, byte, chars = [], 0, 0
    for a, b in hit:  # in order, so each byte is decoded once
        ends = []
        for to in (words[a][0], words[b - 1][1]):
            chars += len(raw[byte:to].decode("utf-8", "surrogatepass"))
            byte = to
            ends.append(chars)
        out.append({"start": ends[0], "end": ends[1]})
    return out


def _row(doc, text, n_words: int, hit: list[tuple[int, int]], items: set[str]) -> dict:
    n_hit = sum(b - a for a, b in hit)
    names = sorted(items)
    return {
        "doc_id": doc, "n_words": n_words, "n_hit": n_hit, "n_items": len(names),
        "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
        "contaminated": n_hit > 0 and 20 * n_hit >= n_words, "items": names, "spans": _spans(text, hit) if hit else [],
    }


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
    ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def shards(items: Iterator, limit: int = SHARD_WORDS) -> Iterator[list[tuple[object, str]]]:
    """Lists of items of about so many words, at least one list."""
    held, size = [], 0
    for item, text in items:
        n = len(normal_words(text))
        if size + n > limit and held:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    yield held


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches of about so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id",
                  item_text_col="text", width: int = WIDTH, shard_words: int = SHARD_WORDS, carry: bool = False) -> DataFrame:
    """One row per document: words, hit words, items found, their digest, verdict, hit spans in the original text.

    With ``carry`` the input row comes along in a column ``row``.
    """
    spark = documents.sparkSession
    items = benchmark.select(item_col, item_text_col).where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    # rows stream to the driver, and each shard leaves it as a broadcast before the next is read
    cast = [spark.sparkContext.broadcast(g) for g in shards(((r[0], r[1]) for r in items.toLocalIterator()), shard_words)]

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = WindowAutomaton(cast[0].value, width) if len(cast) == 1 else None
        for held in gathered(batches, 0 if only else GATHERED_BYTES):
            columns = [batch.column(1).field(text_col) if carry else batch.column(1) for batch in held]
            counts = [[0] * len(batch) for batch in held]
            found: dict[tuple[int, int], tuple[list, set]] = {}
            for part in cast:  # more than one automaton never stands in memory at once
                machine = only or WindowAutomaton(part.value, width)
                for at, texts in enumerate(columns):
                    for k in range(len(texts)):
                        words = normal_words(texts[k].as_py())
                        counts[at][k] = len(words)
                        hit, names = machine.hits(words)
                        if hit:
                            old = found.get((at, k), ([], set()))
                            found[at, k] = (merged(old[0] + hit), old[1] | names)
            for at, batch in enumerate(held):
                rows = [_row(d, columns[at][k].as_py() if (at, k) in found else "", counts[at][k], *found.get((at, k), ([], set()))) for k, d in enumerate(batch.column(0).to_pylist())]
                out = pa.RecordBatch.from_pylist(rows, schema=_OUT)
                yield pa.RecordBatch.from_arrays([*out.columns, *batch.columns[1:][: int(carry)]], names=[*out.schema.names, *batch.schema.names[1:][: int(carry)]])

    read = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row") if carry else F.col(text_col).cast("string").alias("text"))
    schema = T._parse_datatype_string(SCHEMA)
    return read.mapInArrow(scan, schema.add("row", documents.schema) if carry else schema)
