"""Lodestone: architecture analytics over code, commits and dependency graphs, on Spark."""
