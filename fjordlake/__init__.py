"""Spatio-temporal forecast analytics on PySpark."""
