"""Scalar functions on vectors and arrays, as Catalyst expressions."""

from pyspark.ml.functions import array_to_vector, vector_to_array

from .distance import cosine, distance, dot, euclidean, hadamard, manhattan, norm

__all__ = ["array_to_vector", "cosine", "distance", "dot", "euclidean", "hadamard", "manhattan", "norm", "vector_to_array"]
