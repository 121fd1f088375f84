"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Tokenising cuts a chunk of texts into pre-tokens with array operations, looks
each distinct pre-token up once through the public tokenizer, and gathers ids.
Added tokens of its file are cut out first and keep their own ids.
Each task then packs its own documents online: whole windows of a long document
go out as they are; the rest is placed at the fill level that minimises the sum
of squared counts of partly filled windows, which a level array tracks.  When a
task ends, open windows that fit together are joined, and only the emptiest are
cut to fill the others up, so no padding is left.  Tasks share nothing: no
shuffle, and a lost task is repeated from its input alone.

Defined cases: a null or empty text is the end id alone; repeated documents are
packed each for itself; a null id is kept; an empty table gives no rows; a text
longer than a window is cut, one of any length is encoded in pieces; of levels
that cost the same the fullest is taken, and an open one before a new one; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roisight.llm._text import CHUNK_BYTES, lean, mix64, power_tables, ranges, text_chunks

WINDOW = 1024
END_ID = 0
#: Distinct pre-tokens that a worker remembers before it starts afresh.
CACHE_ENTRIES = 600_000

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_tables: dict[str, object] = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point, and a hash code for it."""
    if "classes" not in _tables:
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
        everything = points.tobytes().decode("utf-32-le")
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, everything):
                table[points[m.start() : m.end()]] = kind
        _tables["classes"] = table, mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return _tables["classes"]


def pretoken_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, for texts that begin at ``first``; the byte-level BPE splitting rule.

    Runs of letters, numbers or other characters take one blank before them; of
    white space before a run the last character stands alone or joins it; an
    apostrophe that begins a run takes s, t, m, d, re, ve or ll.
    """
    n = len(points)
    kinds = _classes()[0][points]
    new = np.ones(n + 1, bool)
    new[1:n] = kinds[1:] != kinds[:-1]
    new[first[first < n]] = True
    fresh = np.zeros(n + 1, bool)  # a text begins here, or everything has ended
    fresh[first] = True
    fresh[n] = True
    runs = np.flatnonzero(new[:n])
    ends = np.append(runs[1:], n)
    out = new.copy()
    spaces = (kinds[runs] == _SPACE) & ~fresh[ends]
    last = ends[spaces] - 1
    out[last] = True
    joins = points[last] == 0x20
    out[last[joins] + 1] = False
    quotes = runs[(points[runs] == 0x27) & (ends - runs == 1) & out[runs] & ~fresh[ends]] + 1
    quotes = quotes[kinds[quotes] == _LETTER]
    if len(quotes):
        one = points[quotes]
        two = np.where((quotes + 1 < n) & ~new[np.minimum(quotes + 1, n)], points[np.minimum(quotes + 1, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        for chosen, size in ((single, 1), (double, 2)):
            at = quotes[chosen]
            out[at] = False
            out[at + size] = True
    return np.flatnonzero(out[:n])


class BatchTokenizer:
    """Ids of many texts at once; each distinct pre-token goes through the tokenizer once."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("added tokens must match as they are: without single_word, lstrip, rstrip and normalized")
        self.added = sorted((t.content for t in added), key=len, reverse=True)  # the longest at a place wins
        self.pattern = regex.compile("|".join(map(regex.escape, self.added)))
        self.limit = cache_entries
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted; ``number`` has each key's place in ``starts``
        self.number = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        base, sizes = len(self.keys), []
        for k in range(0, len(pieces), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[k : k + 4096], add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            used = int(self.starts[-1]) + sum(int(x.sum()) for x in sizes)
            total = int(size.sum())
            if used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
            self.flat[used : used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
            sizes.append(size)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.number = np.insert(self.number, where, np.arange(base, base + len(keys)))

    def _added_spans(self, text: str, at: np.ndarray) -> np.ndarray:
        """Starts and ends (two rows) of added tokens; none reaches over the end of a text."""
        if not any(t in text for t in self.added):
            return np.zeros((2, 0), np.int64)
        spans = [m.span() for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for m in self.pattern.finditer(text, b, e)]
        return np.array(spans, np.int64).reshape(-1, 2).T

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts -> all ids, and where each text's ids begin (one more than texts).

        A text far longer than a chunk is encoded in pieces.
        """
        if len(data) <= 2 * CHUNK_BYTES:
            return self._encode(data, offsets)
        ids, at = [], [0]
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            cuts = piece_cuts(data[lo:hi], CHUNK_BYTES)
            ids += [self._encode(data[lo + a : lo + b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at.append(at[-1] + sum(map(len, ids[len(ids) - len(cuts) + 1 :])))
        return np.concatenate(ids), np.array(at)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        text = data.tobytes().decode("utf-8")
        if len(text) == len(data):
            points, at = data.astype(np.uint32), offsets
        else:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            seen = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
            at = seen[offsets]
        added = self._added_spans(text, at)
        begins = pretoken_starts(points, np.concatenate([at[:-1], added.ravel()]))
        if added.size:
            within = np.searchsorted(added[0], begins, "left") - 1  # the last token that starts before
            begins = begins[(within < 0) | (begins >= added[1][within])]
        ends = np.append(begins[1:], len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        up, down = power_tables(len(points) + 1)
        np.cumsum(_classes()[1][points] * up[: len(points)], out=sums[1:])
        keys = (sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._reset()
        place = np.searchsorted(self.keys, distinct)
        unseen = np.ones(len(distinct), bool)
        within = place < len(self.keys)
        unseen[within] = self.keys[place[within]] != distinct[within]
        if unseen.any():
            b, e = begins[where[unseen]].tolist(), ends[where[unseen]].tolist()
            self._learn(distinct[unseen], [text[x:y] for x, y in zip(b, e, strict=True)])
            place = np.searchsorted(self.keys, distinct)
        number = self.number[place]
        size_of = self.starts[number + 1] - self.starts[number]
        sizes = size_of[which]
        ids = self.flat[np.repeat(self.starts[number][which], sizes) + ranges(sizes)]
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        return ids, total[np.searchsorted(begins, at)]


def piece_cuts(data: np.ndarray, size: int) -> list[int]:
    """Where a text may be cut about every ``size`` bytes: at single blanks between visible ASCII, which begin a pre-token and lie in no added token."""
    blank = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    plain = lambda x: (x > 0x20) & (x < 0x7F)
    blank = blank[plain(data[blank - 1]) & plain(data[blank + 1])]
    cuts = [0]
    while len(data) - cuts[-1] > size and (k := int(np.searchsorted(blank, cuts[-1] + size))) < len(blank):
        cuts.append(int(blank[k]))
    return [*cuts, len(data)]


class SumOfSquares:
    """Online packer: ``add`` yields rows of closed windows, ``finish`` those of the rest."""

    def __init__(self, first_sequence: int = 0, window: int = WINDOW):
        self.window, self.next = window, first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.moved = 0  # tokens that left the window they were placed in
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Rows (doc, start, ids, doc tokens, sequence, offset)."""
        total, at = len(ids), 0
        while total - at >= self.window:
            yield doc, at, ids[at : at + self.window], total, self._sequence(), 0
            at += self.window
        size = total - at
        if not size:
            return
        level = self._level(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        pieces.append((doc, at, ids[at:].copy(), total))  # not a view that keeps the whole document
        if level + size == self.window:
            yield from self._close(pieces)
        else:
            self.open[level + size].append(pieces)
            self.counts[level + size] += 1

    def _level(self, size: int) -> int:
        top = self.window - size
        held = np.flatnonzero(self.counts[1 : top + 1]) + 1
        reached = self.counts[held + size]
        gain = 2 * (reached - self.counts[held]) + 2
        gain[held + size == self.window] -= 2 * reached[held + size == self.window] + 1
        alone = 2 * int(self.counts[size]) + 1
        if not len(held):
            return 0
        best = len(held) - 1 - int(np.argmin(gain[::-1]))
        return int(held[best]) if gain[best] <= alone else 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        sequence, offset = self._sequence(), 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, sequence, offset
            offset += len(ids)

    def finish(self) -> Iterator[tuple]:
        """Close what is open, with what was placed together kept together.

        Windows that fit into one are joined, the fullest with the fullest that
        fits.  Then the emptiest are cut to fill up the fullest; what is left in the
        end goes into powers of two, so nothing is padded.
        """
        levels = [level for level, held in enumerate(self.open) for _ in held]
        held = [pieces for one in self.open for pieces in one]
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        joined: deque[tuple[int, list[tuple]]] = deque()
        while levels:
            level, pieces = levels.pop(), held.pop()
            while (k := bisect_right(levels, self.window - level) - 1) >= 0:
                level += levels.pop(k)
                pieces = pieces + held.pop(k)
            joined.append((level, pieces))
        joined = deque(sorted(joined, key=lambda x: -x[0]))
        while joined:
            level, pieces = joined.popleft()
            while level < self.window and joined:
                size, donor = joined.pop()
                given, kept = _taken(donor, self.window - level)
                pieces, level, size = pieces + given, level + sum(len(p[2]) for p in given), sum(len(p[2]) for p in kept)
                self.moved += sum(len(p[2]) for p in given)
                if kept:
                    joined.append((size, kept))
            while level < self.window and level & (level - 1):
                part = 1 << (level.bit_length() - 1)
                given, pieces = _taken(pieces, part)
                level -= part
                yield from self._close(given)
            yield from self._close(pieces)


def _taken(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``size`` tokens of pieces, and the rest."""
    given, at = [], 0
    while at < len(pieces) and size:
        doc, start, ids, total = pieces[at]
        if len(ids) > size:
            return [*given, (doc, start, ids[:size], total)], [(doc, start + size, ids[size:], total), *pieces[at + 1 :]]
        given.append(pieces[at])
        size -= len(ids)
        at += 1
    return given, pieces[at:]


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    docs, starts, ids, totals, sequences, offsets = columns
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
         pa.array(totals, pa.int64()), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def pack(documents: DataFrame, tokenizer_path: str, *, id_col="doc_id", text_col="text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece; ``ids`` holds its token ids as little-endian unsigned 32-bit numbers."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = SumOfSquares((context.partitionId() if context else 0) << 40, window)
        tokenizer = _tables.get(tokenizer_path) or _tables.setdefault(tokenizer_path, BatchTokenizer(tokenizer_path))
        end = np.array([end_id], np.uint32)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                ids, at = tokenizer.encode(data, offsets)
                for k in range(lo, hi):
                    for row in packer.add(docs[k], np.concatenate([ids[at[k - lo] : at[k - lo + 1]], end])):
                        rows.append(row)
                        held += len(row[2])
                if held > 1_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
        rows += packer.finish()
        if rows:
            yield _batch(rows)

    return documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
