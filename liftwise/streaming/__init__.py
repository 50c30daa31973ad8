"""The view over a stream of fact files (Structured Streaming)."""
