"""Lodestar: catalog analytics over hierarchical metadata, written as Spark DataFrame plans."""
