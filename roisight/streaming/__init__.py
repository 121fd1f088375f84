"""Features of images as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from roisight.api import extract_features


def extract_stream(voxels: DataFrame, images: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Runs the extraction on each micro-batch of a streaming voxel table.

    A region arrives whole within a batch (files of one image come together), so
    there is no state; ``sink`` gets each batch's features and its number.
    """

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            if not held.isEmpty():
                sink(extract_features(held, images.join(held.select("image_id").distinct(), "image_id", "left_semi"), **options), number)
        finally:
            held.unpersist()

    return voxels.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
