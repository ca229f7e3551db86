"""Reconciliation of a member table with a versioned external registry, on Spark."""
