"""Structured Streaming forms of the landing job."""

from vellum.streaming.landing_stream import land_stream

__all__ = ["land_stream"]
