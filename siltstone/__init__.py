"""Siltstone: a Spark-native engine for content risk and data-set hygiene."""

from siltstone.session import checkpoint, get_spark, shared_dir

__all__ = ["checkpoint", "get_spark", "shared_dir"]
