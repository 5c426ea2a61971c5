"""Strict JSON analytics on Spark: lossless JSON operators over string columns."""
