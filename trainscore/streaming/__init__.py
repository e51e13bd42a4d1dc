"""Scoring a stream of requests."""

from .requests import read_requests, run_stream, start_stream

__all__ = ["read_requests", "run_stream", "start_stream"]
