"""Molecular interface geometry as Spark DataFrame operators."""
