"""Manifold learning and training-data operators on Spark DataFrames."""
