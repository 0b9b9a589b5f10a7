"""Queries assembled from operators."""
