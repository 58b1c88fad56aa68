"""specloom: a Spark-native engine for source-traced specification catalogs and text corpora."""

__version__ = "0.1.0"
