"""tidemark: a PySpark-native engine for incremental evidence pipelines and training-data preparation."""

__version__ = "0.1.0"
