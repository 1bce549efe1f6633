"""Claim-text analytics as Spark DataFrame operators and ML pipelines."""

__version__ = "0.1.0"
