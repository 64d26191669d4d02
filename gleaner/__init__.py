"""Gleaner: declarative extraction over captured web pages, on PySpark DataFrames."""
