"""Streams of interaction events."""
