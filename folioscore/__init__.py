"""Evaluation of document-understanding output at scale, on Spark DataFrames."""
