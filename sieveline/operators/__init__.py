"""Operators on DataFrames: objects, windows, data sets, reports and triage."""
