"""Operators: functions from DataFrames to DataFrames; none collects rows to the driver."""
