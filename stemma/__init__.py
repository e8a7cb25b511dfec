"""Stemma: analytics over versioned document collections, as Spark DataFrames."""
