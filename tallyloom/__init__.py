"""Tallyloom: content-integrity and corpus analytics on Spark DataFrames."""
