"""Named analyses: importing the package registers them."""

from pathloom.analyses import catalogue  # noqa: F401
from pathloom.analyses.base import AnalysisResult, CubeSet, UnknownAnalysisError, get, names, run

__all__ = ["AnalysisResult", "CubeSet", "UnknownAnalysisError", "get", "names", "run"]
