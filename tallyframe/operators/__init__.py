"""Operators: functions from DataFrames to DataFrames, over all rows, independent of partitioning."""
