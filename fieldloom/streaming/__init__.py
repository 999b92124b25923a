"""Streaming forms of frame building and pairing."""
