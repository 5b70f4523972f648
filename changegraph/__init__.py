"""changegraph: Spark operators for analysing changes, code facts and dependency graphs at scale."""

__version__ = "0.1.0"
