"""Listing analytics on Spark: extraction, resolution, state, reading and measuring of event listings."""
