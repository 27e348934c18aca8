"""Metric pipelines: each is a function DataFrame(s) -> DataFrame."""
