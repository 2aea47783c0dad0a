"""Metrics and log events on Spark: parse, aggregate, stitch, enrich, encode."""
