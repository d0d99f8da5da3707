"""A stream of documents into an index: each micro-batch becomes a segment, and full size classes are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marginalia.sources.postings import Index


def ingest(stream: DataFrame, path: str, doc_id: str, checkpoint: str, merge: bool = True, **trigger) -> StreamingQuery:
    """Start adding the stream's rows to the index at path. A batch that runs again after a failure replaces its own
    documents, so they count once. trigger: as for DataStreamWriter.trigger, availableNow by default."""

    def one(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        index = Index(df.sparkSession, path)
        index.add(df, doc_id)
        if merge:
            index.merge()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
