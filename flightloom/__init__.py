"""Batch and streaming Spark jobs for mission risk, evidence retrieval and corpus preparation."""
