"""Veritrail: claim verification and text-corpus analytics as Spark DataFrame programs."""

__version__ = "0.1.0"
