"""Spark ML: preprocessing pipelines, training with metrics, batch scoring."""
