"""Feedlake: order-book feed normalization and analytics on PySpark DataFrames."""
