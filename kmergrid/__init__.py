"""kmergrid: k-mer sketch analytics as Spark DataFrame jobs."""

from .config import DistanceConfig, QueryConfig, SketchConfig

__all__ = ["DistanceConfig", "QueryConfig", "SketchConfig"]
