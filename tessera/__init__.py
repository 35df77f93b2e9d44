"""Tessera: SPARQL 1.1 and training-data operators on Spark DataFrames."""
