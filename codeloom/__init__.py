"""codeloom: source-corpus analytics as Spark DataFrame jobs."""

from codeloom.config import AnalysisConfig

__all__ = ["AnalysisConfig"]
