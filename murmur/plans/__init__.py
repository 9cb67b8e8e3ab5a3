"""Composed plans: the registered query catalog and the end-to-end pipelines."""
