"""SPARQL text, algebra and rewriting: everything that happens before DataFrames exist."""
