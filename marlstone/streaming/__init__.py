"""Streams of the engine."""
