"""Operators: functions from DataFrames and Columns to DataFrames and Columns."""
