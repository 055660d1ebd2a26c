"""citegraph: citation analytics as Spark DataFrame jobs.

Layers:
  functions/  Column expressions (title keys, tokenizers, regex constants)
  sources/    captures, epoch globs, sinks, build-or-load caches
  operators/  layout, citations, graph, similarity, index/search, learning, sampling
  plans/      user-level jobs (ingest, extract, invert, index) and the query registry
  streaming/  incremental ingest with Structured Streaming
"""

from citegraph.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
