from loomtext.streaming.requests import read_request_stream, start_stream
from loomtext.streaming.sessions import read_line_stream, stream_requests, stream_take_while

__all__ = ["read_line_stream", "read_request_stream", "start_stream", "stream_requests", "stream_take_while"]
