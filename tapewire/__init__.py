"""Spark-native analytics over news articles and daily price bars.

Every operator takes DataFrames and returns a DataFrame.  Nothing here reads a
clock: the moment a query refers to is always an ``as_of`` argument.
"""
