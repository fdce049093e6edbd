"""Spatio-temporal analytics over observation tables, on Spark DataFrames."""
