"""Weak-supervision analytics on Spark: labels, evaluation, series, text and stores as DataFrame plans."""
