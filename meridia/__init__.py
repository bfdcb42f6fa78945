"""Meridia: evidence-aware multi-criteria location analytics on Spark DataFrames."""
