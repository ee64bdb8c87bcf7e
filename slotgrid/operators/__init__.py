"""Operators on gridded series, DataFrame to DataFrame."""
