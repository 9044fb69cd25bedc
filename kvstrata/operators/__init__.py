"""Operators on snapshots, logs and blobs. Pure functions from DataFrame to DataFrame."""
