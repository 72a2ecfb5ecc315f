"""Sequence, network, gene-list, expression and clinical analytics on Spark DataFrames."""
