"""Embedding the rows of a stream with a trained encoder: stateless, so no watermark and no late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.estimators import ParametricUmapModel


def embed_stream(stream: DataFrame, model: ParametricUmapModel, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the embedded rows of ``stream`` as Parquet to ``path``, exactly once; with ``once``, what is there now."""
    out = model.transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
