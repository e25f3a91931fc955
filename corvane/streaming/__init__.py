"""The change pipeline on Structured Streaming."""
