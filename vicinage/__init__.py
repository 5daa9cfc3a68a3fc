"""Nearest-neighbour graphs over DataFrames, Spark first."""
