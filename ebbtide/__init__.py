"""Recurring-payment analytics on Spark DataFrames."""
