"""Offer analytics on Spark: DataFrame, SQL and Structured Streaming operators."""
