"""Streaming versions of the session operators."""
