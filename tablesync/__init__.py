"""Keeping copies of relational tables in step, as DataFrame and Structured Streaming jobs."""
