"""Logical plans: mutation logs, snapshots and scans. Pure functions from DataFrame to DataFrame."""
