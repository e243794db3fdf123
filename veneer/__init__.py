"""veneer: surface-form audits of text benchmarks as PySpark jobs."""

__version__ = "0.1.0"
