"""repoloom: a Spark-native analytics engine for source-code repositories and text corpora."""

__version__ = "0.1.0"
