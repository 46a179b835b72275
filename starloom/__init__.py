"""Spark-native single-dish radio mapping: calibrated samples in, sky maps and source lists out."""
