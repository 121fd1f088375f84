"""Secret scan: keyword automaton, anchored expressions at its hits, then checksum validation.

One Aho-Corasick automaton finds the keywords of all kinds in the lower-cased
text; a kind's expression is tried only where one of its keywords begins.  Runs
of hexadecimal digits have no keyword, so they are found by one linear scan.
Kinds with embedded checks (a CRC-32 suffix in base 62, a JSON header) keep only
matches that validate.  Matches of one kind are leftmost and do not overlap.

Spans are (kind, start, end) in code points, end exclusive, ordered by start,
then by kind as listed in ``KINDS``.  Defined cases: a null or empty text has no
spans; an empty table gives no rows; repeated rows give a row each; a null id is
kept; equal starts go by kind; a text of any length is scanned whole, in time that
grows with its length; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix_valid(token: bytes) -> bool:
    """The last six characters are the CRC-32 of the characters after the prefix, in base 62."""
    body = token.split(b"_", 1)[1]
    value = zlib.crc32(body[:-6])
    digits = ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = _BASE62[d] + digits
    return digits.encode() == body[-6:]


def json_header_valid(token: bytes) -> bool:
    """The first dotted part is base64url of a JSON object that names an algorithm."""
    head = token.split(b".", 1)[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(found, dict) and "alg" in found


class Kind(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"),
         re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: len(m[2]) >= 12),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    Kind("hex", (), re.compile(rb"[0-9a-f]{16,}"), lambda m: True),
    Kind("hosting", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), re.compile(rb"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc_suffix_valid(m[0])),
    Kind("jwt", ("eyj",), re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), lambda m: json_header_valid(m[0])),
    Kind("chat", ("xoxb-", "xoxp-", "xoxa-"), re.compile(rb"xox[bpa]-[0-9]{8,}-[A-Za-z0-9-]{16,}"), lambda m: True),
    Kind("payment", ("sk_live_", "rk_live_"), re.compile(rb"[sr]k_live_[A-Za-z0-9]{16,}"), lambda m: True),
    Kind("private_key", ("-----begin ",), re.compile(rb"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----"), lambda m: True),
)


def keyword_automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for number, kind in enumerate(KINDS):
        for word in kind.keywords:
            machine.add_word(word, (number, len(word)))
    machine.make_automaton()
    return machine


def char_offsets(raw: bytes, at: list[int]) -> dict[int, int]:
    """Code-point offsets of byte positions, in one pass."""
    out, byte, chars = {}, 0, 0
    for p in sorted(set(at)):
        chars += len(raw[byte:p].decode("utf-8"))
        out[p] = chars
        byte = p
    return out


def find_spans(raw: bytes, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    starts: dict[int, list[int]] = {}
    for end, (number, size) in machine.iter(raw.lower().decode("latin-1")):
        starts.setdefault(number, []).append(end + 1 - size)
    found = []
    for number, kind in enumerate(KINDS):
        if kind.keywords:
            last = 0
            for at in sorted(starts.get(number, ())):
                if at >= last and (m := kind.pattern.match(raw, at)):
                    last = m.end()
                    if kind.valid(m):
                        found.append((m.start(), number, m.end()))
        else:
            found += [(m.start(), number, m.end()) for m in kind.pattern.finditer(raw) if kind.valid(m)]
    if not found:
        return []
    found.sort()
    at = char_offsets(raw, [p for a, _, b in found for p in (a, b)])
    return [(KINDS[number].name, at[a], at[b]) for a, number, b in found]


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def scan_secrets(documents: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document with all spans found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = keyword_automaton()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t.as_py() or b"", machine)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _OUT.field(1).type)], schema=_OUT)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
