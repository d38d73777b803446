"""Operators: functions from DataFrames to DataFrames, lazy and free of actions."""
