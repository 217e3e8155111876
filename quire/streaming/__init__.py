"""Structured Streaming: the outbox as a stream of updates, and event-time extensions."""
