"""Readers, writers and the binding of relational tables to a graph."""
