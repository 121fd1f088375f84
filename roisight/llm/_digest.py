"""Digest columns that queries derive from spans, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(spans: str, base: list[str]) -> list[Column]:
    return [
        *(count_kind(spans, k).alias(f"n_{k}") for k in base),
        F.sha2(span_list(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_list(F.col(spans)).alias("spans"),
    ]
