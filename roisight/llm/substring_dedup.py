"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

A window is ``width`` consecutive words of one document.  A word goes if a
window covers it whose word sequence also starts in a document with a smaller
id; windows are judged on the input.

1. A task hashes all windows of its documents.  Of windows repeated
   within the task only those of the smallest id travel on; the others are
   decided there, so a passage that a third of all documents hold is one entry
   for each task, not for each document.
2. Entries travel as sorted, delta-coded blocks, one for each range of hashes,
   and a range's task finds the smallest id of each hash.
3. Window starts come together for each document and merge into maximal
   removal intervals, which are joined to the text.

Window equality is equality of a 64-bit hash and of a 32-bit one with another
base, 96 bits together: with n windows about n*n/2**97 pairs of different ones are
taken as equal (6e-4 for the 1e13 windows of 100 TB).

Defined cases: a null or empty text has no words; a null id neither removes nor
loses words; rows that repeat an id do not remove each other's words; a text
shorter than a window stays whole, one of any length is cut into windows whole;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roisight.llm._store import checkpointed, maybe_broadcast
from roisight.llm._text import NON_SPACE, mix64, ranges, text_chunks, window_hashes, word_hashes, word_spans

WIDTH = 13
#: Windows that a task sorts at once, and most windows in a range of hashes.
PIECE_WINDOWS = 1_000_000
RANGE_WINDOWS = 4_000_000
#: Bytes of entries sent at once.
SENT_BYTES = 4 << 20


def planes(values: np.ndarray) -> bytes:
    """Bytes of the same significance side by side: leading zeros of small numbers compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def deltas(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def from_deltas(raw: bytes, dtype) -> np.ndarray:
    return np.cumsum(from_planes(raw, dtype), dtype=dtype)


def check_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """32 more bits for each window, from a polynomial in other numbers of its words."""
    return (window_hashes(mix64(words ^ np.uint64(0x6A09E667F3BCC909)), width) >> np.uint64(32)).astype(np.uint32)


def sorted_order(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The stable order by hash and check; checks are looked at only where one hash has several."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    return np.lexsort((checks, hashes)) if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any() else order


def smallest(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each of sorted entries, the smallest id among those of the same hash and check."""
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])]))
    return np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(hashes))))


def merge_starts(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [begin, end) word intervals covered by windows at these sorted starts."""
    fresh = np.concatenate([[True], starts[1:] > starts[:-1] + width])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)
    return starts[fresh], starts[last] + width


def entries_by_range(part_count: int, width: int):
    """Rows (part, local, hashes, numbers, ids, tags, firsts, checks) for batches of (id, tag, text)."""

    def emit(kept: list[tuple], piece: int) -> Iterator[dict]:
        hashes, checks, counts, ids, tags = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        firsts = np.cumsum(counts) - counts
        order = sorted_order(hashes, checks).astype(np.uint32)
        hashes, checks = hashes[order], checks[order]
        owner = np.repeat(np.arange(len(ids), dtype=np.uint32), counts)[order]
        from_ids = ids[owner]
        gone = from_ids > smallest(hashes, checks, from_ids)
        del from_ids
        if gone.any():
            at = np.sort(order[gone])
            who = np.searchsorted(firsts + counts, at, "right")
            held, number = np.unique(who, return_counts=True)
            yield {"part": piece % part_count, "local": True, "hashes": deltas((at - firsts[who]).astype(np.uint32)), "numbers": planes(number.astype(np.uint32)),
                   "ids": deltas(ids[held]), "tags": planes(tags[held]), "firsts": b"", "checks": b""}
        hashes, checks, order, owner = hashes[~gone], checks[~gone], order[~gone], owner[~gone]
        part = (((hashes >> np.uint64(32)) * np.uint64(part_count)) >> np.uint64(32)).astype(np.int32)
        for p, lo, hi in _slices(part):
            held = np.unique(owner[lo:hi])
            yield {"part": int(p), "local": False, "hashes": deltas(hashes[lo:hi]), "numbers": planes(order[lo:hi]),
                   "ids": deltas(ids[held]), "tags": planes(tags[held]), "firsts": deltas(firsts[held].astype(np.uint32)), "checks": planes(checks[lo:hi])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, piece = [], 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                starts, ends, first = word_spans(data, offsets, NON_SPACE)
                if not len(starts):
                    continue
                words = word_hashes(data, starts, ends)
                all_hashes, all_checks = window_hashes(words, width), check_hashes(words, width)
                counts = np.maximum(np.diff(first) - width + 1, 0)
                own = np.repeat(first[:-1], counts) + ranges(counts)
                some = counts > 0
                if some.any():
                    kept.append((all_hashes[own], all_checks[own], counts[some], ids[lo:hi][some].astype(np.int64), tags[lo:hi][some].astype(np.int32)))
                    size += len(own)
                if size >= PIECE_WINDOWS:
                    yield from _sent(emit(kept, piece))
                    kept, size, piece = [], 0, piece + 1
        if kept:
            yield from _sent(emit(kept, piece))

    return run


def _sent(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Entries in batches of about ``SENT_BYTES``, so that neither side holds a whole piece of them."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= SENT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=_ENTRIES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ENTRIES)


def _slices(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_values):
        first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
        yield from zip(sorted_values[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_values)).tolist(), strict=True)


ENTRIES = "part int, local boolean, hashes binary, numbers binary, ids binary, tags binary, firsts binary, checks binary"
_ENTRIES = pa.schema([("part", pa.int32()), ("local", pa.bool_()), *((n, pa.binary()) for n in ("hashes", "numbers", "ids", "tags", "firsts", "checks"))])
STARTS = "doc_id long, tag int, starts binary"
_STARTS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("starts", pa.binary())])


def repeated_starts(table: pa.Table) -> pa.Table:
    """Window starts to remove, by document, from all blocks of one range of hashes."""
    out_ids, out_tags, out_starts = [], [], []
    hashes, checks, ids, tags, at = [], [], [], [], []
    for row in (table.slice(k, 1).to_pylist()[0] for k in range(len(table))):
        own, mark = from_deltas(row["ids"], np.int64), from_planes(row["tags"], np.int32)
        if row["local"]:
            number = from_planes(row["numbers"], np.uint32)
            who = np.repeat(np.arange(len(own)), number)
            starts = from_deltas(row["hashes"], np.uint32)
            for k, lo, hi in _slices(who):
                out_ids.append(int(own[k])), out_tags.append(int(mark[k])), out_starts.append(starts[lo:hi].tobytes())
            continue
        number, first = from_planes(row["numbers"], np.uint32), from_deltas(row["firsts"], np.uint32)
        who = np.searchsorted(first, number, "right") - 1
        hashes.append(from_deltas(row["hashes"], np.uint64)), checks.append(from_planes(row["checks"], np.uint32))
        ids.append(own[who]), tags.append(mark[who]), at.append(number - first[who])
    if hashes:
        h, c, i, t, a = (np.concatenate(x) for x in (hashes, checks, ids, tags, at))
        for parts in (hashes, checks, ids, tags, at):
            parts.clear()
        order = sorted_order(h, c).astype(np.uint32)
        h, c, from_ids = h[order], c[order], i[order]
        gone = order[from_ids > smallest(h, c, from_ids)]
        del h, c, from_ids, order
        i, t, a = i[gone], t[gone], a[gone]
        order = np.lexsort((a, t, i))
        i, t, a = i[order], t[order], a[order].astype(np.uint32)
        if len(i):
            first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(i)).tolist(), strict=True):
                out_ids.append(int(i[lo])), out_tags.append(int(t[lo])), out_starts.append(a[lo:hi].tobytes())
    return pa.table([pa.array(out_ids, pa.int64()), pa.array(out_tags, pa.int32()), pa.array(out_starts, pa.binary())], schema=_STARTS)


def _intervals(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts in batch.column(2).to_pylist():
                starts = np.unique(np.frombuffer(b"".join(parts), np.uint32)).astype(np.int64)
                found.append(np.stack(merge_starts(starts, width), 1).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "tag", "removed"])

    return run


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept, removed = [], [], [], []
        for text, raw in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            words = (text.as_py() or b"").split()
            gone = np.frombuffer(raw, np.uint32).reshape(-1, 2).tolist() if raw else []
            n_words.append(len(words))
            n_removed.append(sum(b - a for a, b in gone))
            for a, b in reversed(gone):
                del words[a:b]
            kept.append(b" ".join(words))
            removed.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, _CUT.field(4).type)], schema=_CUT)


def remove_repeats(documents: DataFrame, *, id_col="doc_id", text_col="text", width: int = WIDTH) -> DataFrame:
    """One row per document: words, removed words, kept words joined by a blank, removed word intervals."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tag = F.hash("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = size / 6
    parts = max(1, math.ceil(math.sqrt(windows / 30_000)), math.ceil(windows / RANGE_WINDOWS))
    entries = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", tag.alias("tag"), "text").mapInArrow(entries_by_range(parts, width), ENTRIES)
    starts = entries.groupBy("part").applyInArrow(repeated_starts, STARTS)
    gathered = starts.groupBy("doc_id", "tag").agg(F.collect_list("starts").alias("starts"))
    intervals = checkpointed(gathered.mapInArrow(_intervals(width), "doc_id long, tag int, removed binary"))
    total = intervals.agg(F.sum(F.octet_length("removed"))).first()[0] or 0
    rows = max(1, intervals.count())
    side = maybe_broadcast(intervals, 40 + total // rows)
    joined = docs.withColumn("tag", tag).join(side, ["doc_id", "tag"], "left")
    return joined.select("doc_id", "text", "removed").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<long>>")
