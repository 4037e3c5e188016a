"""Operators on documents, graphs, builds and logs."""
