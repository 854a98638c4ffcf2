"""Streaming scorer, an extension: documents that arrive in a stream are scored by fitted stage-1 trees.

The trees are a small static table; each micro-batch is a plain join and walk, so the query keeps no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators import trees as T


def start(stream: DataFrame, trees: DataFrame, keys: list[str], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write ``stream`` (keys.., qid, doc_id, features) with leaf and score to Parquet under ``out``.

    Batch ids name the folders, so a batch that runs again after a failure overwrites itself: each document once.
    """
    models = trees.persist()

    def write(batch: DataFrame, number: int) -> None:
        T.apply(batch, models, keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
