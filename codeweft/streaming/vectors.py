"""Embeddings kept up to date from a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codeweft.sources.store import Store


def embed_stream(texts: DataFrame, store: Store, model: str, embed, checkpoint: str, **trigger) -> StreamingQuery:
    """texts: a stream of hash and text. Each micro-batch adds the vectors that the cache lacks; a batch that is run
    again after a failure adds nothing twice to what readers of the cache see."""

    def add(batch: DataFrame, _: int) -> None:
        store.add_vectors(model, store.missing(model, batch).select("hash", embed("text").alias("embedding")))

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
