"""Retrieval analytics over structured text, declared as Spark plans."""
