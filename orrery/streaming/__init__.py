"""Structured Streaming: the same operators over streams of reports."""
