"""tidemark: longitudinal datasets from archived web captures, as Spark DataFrame operators."""

__version__ = "0.1.0"
