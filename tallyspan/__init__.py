"""Interval, coverage and signal-profile operators over DataFrames."""
