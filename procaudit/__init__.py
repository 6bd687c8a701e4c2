"""Batch jobs over tables of audited procedure codes, in Spark."""
