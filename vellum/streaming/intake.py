"""Continuous intake: micro-batches of assets go through the incremental build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vellum.engine import Engine


def build_stream(engine: Engine, assets: DataFrame, checkpoint: str, trigger: dict | None = None, rebuild_rollups: bool = True) -> StreamingQuery:
    """Build every micro-batch of a stream of assets.

    The build is idempotent by content, so a batch that is replayed after a
    failure is skipped.
    """

    def batch(df: DataFrame, _: int) -> None:
        kept = df.persist()
        try:
            engine.add_source(kept).build(rebuild_rollups=rebuild_rollups)
        finally:
            kept.unpersist()

    return assets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
