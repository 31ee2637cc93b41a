"""Event-time feature analytics on Spark."""

from lodestream.runtime import get_spark

__all__ = ["get_spark"]
__version__ = "0.1.0"
