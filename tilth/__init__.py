"""Agronomic analytics on Spark: time series of parcels, and the decisions built on them."""
