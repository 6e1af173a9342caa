"""winnow: feature selection for binary classifiers as Spark jobs."""

__version__ = "0.1.0"
