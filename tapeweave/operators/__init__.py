"""Operators over bars, news, signals and trades; each takes and returns DataFrames."""
