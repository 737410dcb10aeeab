"""Part of the learning-graph engine."""
