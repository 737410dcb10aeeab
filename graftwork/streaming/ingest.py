"""Proposals as streams: each micro-batch is one message to the graph.

A file stream of proposals is admitted batch by batch in ``foreachBatch``; the graph writes a batch under the stream's own
batch number, so a batch that is retried after a failure replaces itself. The event log is read as a
stream by ``event_line_stream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graftwork import schemas
from graftwork.engine import LearningGraph
from graftwork.plans import views


def _start(stream: DataFrame, checkpoint: str, step) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admit_node_stream(graph: LearningGraph, folder: str, checkpoint: str, first_batch: int = 0) -> StreamingQuery:
    """Admits every file of node proposals in a folder, one file a batch."""
    stream = graph.spark.readStream.schema(schemas.NODE_PROPOSAL).option("maxFilesPerTrigger", 1).parquet(folder)
    return _start(stream, checkpoint, lambda rows, n: graph.add_nodes(rows, first_batch + n) and None)


def admit_edge_stream(graph: LearningGraph, folder: str, checkpoint: str, first_batch: int = 0) -> StreamingQuery:
    stream = graph.spark.readStream.schema(schemas.EDGE_PROPOSAL).option("maxFilesPerTrigger", 1).parquet(folder)
    return _start(stream, checkpoint, lambda rows, n: graph.add_edges(rows, first_batch + n) and None)


def event_line_stream(spark: SparkSession, events: str, out: str, checkpoint: str) -> StreamingQuery:
    """Renders the event log to text lines as it grows."""
    stream = spark.readStream.schema(schemas.EVENTS + ", batch_id bigint, part bigint").parquet(events)
    nodes = stream.where("event_type IN ('NodeAccepted', 'NodeRejected')")
    edges = stream.where("event_type IN ('EdgeAccepted', 'EdgeRejected')")
    lines = views.event_lines(nodes, edges).unionByName(views.summary_event_lines(stream))
    return lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
