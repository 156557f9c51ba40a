"""faunaflux: a Spark-native engine for benchmarking species-distribution models."""

__version__ = "0.1.0"
