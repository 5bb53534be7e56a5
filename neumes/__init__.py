"""Operators on symbolic transcriptions as Spark DataFrames and Columns."""
