"""riskflow: Spark-native transaction-risk analytics."""

__version__ = "0.1.0"
