from tidemark.streaming.refresh_stream import FailedBatch, json_stream, raw_stream, refresh_stream

__all__ = ["FailedBatch", "json_stream", "raw_stream", "refresh_stream"]
