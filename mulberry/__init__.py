"""Spark-native engine for hybrid document retrieval, learner analytics and corpus preparation."""

__version__ = "0.1.0"
