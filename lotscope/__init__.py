"""Data-quality profiling of imported field observations on Spark."""

from lotscope.model import Params, Tables
from lotscope.workspace import Workspace

__all__ = ["Params", "Tables", "Workspace"]
