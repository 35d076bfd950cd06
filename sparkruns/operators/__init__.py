"""Operators on ranked offer sequences; all take and return DataFrames."""
