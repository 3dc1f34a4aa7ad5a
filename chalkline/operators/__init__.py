"""Operators over DataFrames; every one takes its tables as arguments."""
