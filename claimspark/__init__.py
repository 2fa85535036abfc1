"""Claim extraction and reconciliation on Spark."""
