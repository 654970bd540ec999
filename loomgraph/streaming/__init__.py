"""Graph queries over streams.

Node and edge tables of a graph may be streaming DataFrames: patterns without variable-length paths compile to
stream-static or stream-stream joins, which Structured Streaming runs as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomgraph.errors import UnsupportedError
from loomgraph.lang import ast as A
from loomgraph.lang.parser import parse
from loomgraph.sources.graph import PropertyGraph


def streaming_query(graph: PropertyGraph, query: str, parameters: dict | None = None) -> DataFrame:
    """The query as a streaming DataFrame. Variable-length paths need all edges at once and are refused."""
    if any(isinstance(n, A.RelPattern) and n.length for n in A.walk(parse(query))):
        raise UnsupportedError("variable-length paths over a stream")
    df = graph.cypher(query, parameters)
    if not df.isStreaming:
        raise UnsupportedError("no table of this query is a stream")
    return df


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a streaming query into an in-memory table of the given name."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()
