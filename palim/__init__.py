"""Palim: conversational-memory analytics on Spark DataFrames, SQL and Structured Streaming."""
