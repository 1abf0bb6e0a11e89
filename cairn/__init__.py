"""Cairn: archives as relations on Spark DataFrames."""
