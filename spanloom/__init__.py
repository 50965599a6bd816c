"""Spark-native analytics over time-stamped text, intervals and ranked catalogues."""
