"""Structured Streaming jobs: the batch operators on unbounded input, with checkpoints."""
