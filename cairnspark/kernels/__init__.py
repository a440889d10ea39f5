"""Byte kernels in NumPy; no Spark in here."""
