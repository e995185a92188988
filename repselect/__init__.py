"""Batch jobs for choosing among candidate representations, written for Spark."""
