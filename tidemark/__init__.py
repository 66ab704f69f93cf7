"""Tidemark: point-in-time research panels, text pipelines and forecast evaluation as lazy Spark plans."""
