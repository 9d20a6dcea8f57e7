"""cairn: recall, curation and training-data analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
