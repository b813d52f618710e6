"""Streams of record versions."""
