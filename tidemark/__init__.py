"""Behavioural feature, ranking and evaluation analytics on Spark."""
