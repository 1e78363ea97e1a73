"""Continuous indexing: a stream of documents into the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def index_stream(engine: Engine, texts: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index a streaming table ``path, text``, one snapshot a micro-batch.

    A batch that runs again after a failure finds its documents unchanged, so the
    result is the same. With ``once`` the query ends when the input at hand is done."""
    query = texts.writeStream.foreachBatch(lambda df, _: engine.index_texts(df.dropDuplicates(["path"])) and None).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
