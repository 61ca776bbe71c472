"""Batch jobs for public-record evidence on Spark."""
