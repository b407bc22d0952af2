"""Operators for training-data pipelines: one module each, their queries in ``queries``."""
