"""Spark-first engine for typed learning graphs and the data pipelines around them."""
