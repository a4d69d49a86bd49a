"""Measuring the reliability of predictive systems with Spark DataFrames."""
