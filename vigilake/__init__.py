"""Security analytics over code and text corpora, expressed as Spark jobs."""

__version__ = "0.1.0"
