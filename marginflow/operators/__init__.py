"""Operators: functions from DataFrames to DataFrames.

They take a `scope`, the columns that make up one report (store and period). One call
answers all stores and periods; a single report is a filter in front of it.
"""
