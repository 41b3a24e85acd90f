"""Evidence integration, ranking and evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
