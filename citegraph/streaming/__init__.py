from citegraph.streaming.ingest import ingest_stream, invert_stream

__all__ = ["ingest_stream", "invert_stream"]
