"""Graph, aggregate, text, vector and maintenance operators."""
