"""Batch and streaming study-data jobs on Spark: plain functions from DataFrames to DataFrames."""
