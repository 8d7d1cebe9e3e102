"""Reusable table operations for PySpark: plain functions over DataFrames and Columns."""
