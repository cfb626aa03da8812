"""Checks that follow a growing corpus (an extension: the original works on a fixed corpus only)."""

from .follow import follow_chunks

__all__ = ["follow_chunks"]
